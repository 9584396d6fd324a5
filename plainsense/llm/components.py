"""Connected components of an edge table: in one task below a checked size, by alternating large and small stars above.

Every round of stars is a pre-aggregated minimum and a join over the edges. The minima are written before they are
joined, so that both sides of the join are plain shuffles and Spark can split a hub's neighbours among tasks. Each
round's edges are written to the shared folder: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_texts, materialize, remove
from .bitslice import Forest

#: Edges (16 bytes each) that one task may hold.
ONE_TASK = 2_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        forest.join(at[: len(a)], at[len(a) :])
        root = names[forest.root]
        for k in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 100_000]), pa.array(root[k : k + 100_000])], names=["node", "root"])

    return map_texts(edges.coalesce(1), run, "node long, root long", 10_000)


def components(edges: DataFrame, tag: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs), where root is the smallest node reachable; roots themselves too."""
    spark = edges.sparkSession
    star = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, path = materialize(star, tag)
    if star.count() <= one_task:
        return _in_one_task(star)
    while True:
        # large star: every larger neighbour is linked to the smallest one
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large, large_path = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag)
        # small star: the smaller neighbours and the node itself are linked to the smallest one
        most, most_path = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = large.join(most, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        done, new_path = materialize(small, tag)
        for old in (path, least_path, large_path, most_path):
            remove(spark, old)
        star, path = done, new_path
        several = star.groupBy("u").count().where("count > 1").limit(1)
        chained = star.join(star.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        if several.isEmpty() and chained.isEmpty():
            break
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
