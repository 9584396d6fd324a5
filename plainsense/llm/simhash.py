"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius by bit-sliced comparison.

Equal fingerprints are one node. A node's fingerprint is cut into blocks; two within the radius agree in enough blocks
to share at least one key of the block combinations used, so comparing within keys misses no link. Within a key the
fingerprints are stored as bit planes and compared 64 at a time (``bitslice``). A key with many fingerprints is split
into tiles of bounded size that cover all its pairs. Tiles give out spanning forests, never all their pairs.

Defined results: a null or wordless text has fingerprint zero, linked like any other; rows with equal doc_ids are
fingerprinted each; a null doc_id is never the smallest of a group unless all are null; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, kept, map_texts
from .bitslice import links
from .components import components

SEED = 42
RADIUS = 3
#: Fingerprints in one side of a tile.
TILE = 8192
#: A key's expected number of unrelated fingerprints, above which longer keys are used.
CROWD = 512


def _fingerprint(text: str, shingle: int, digest) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    ones, low = np.zeros(64, np.int64), 0
    while low < n:  # a long text's hashes are summed by parts
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[low : low + 65536], last[low : low + 65536], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        low += 65536
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each text's word shingles, as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            prints = np.fromiter((_fingerprint(t or "", shingle, xxh64_intdigest) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), run, schema)


def keys_for(n: int, radius: int = RADIUS) -> list[tuple[tuple[int, int], ...]]:
    """Keys as combinations of (lowest bit, bits): the fewest whose buckets hold about CROWD of ``n`` fingerprints."""
    for extra in range(1, 5):
        blocks = radius + extra
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [*combinations(parts, extra)]
        if n <= CROWD << min(sum(w for _, w in k) for k in found):
            return found
    return found


def _key(fp, parts):
    mask = sum(((1 << w) - 1) << a for a, w in parts)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def tiled(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Adds _tile and _right: keys with more rows than a tile are dealt to tiles that cover all pairs of their chunks.

    ``rows`` has distinct rows with an ``id`` column; it should be a written table, as it is read twice.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # written before the join: both sides are plain shuffles then, and Spark can split a hot key among tasks
    counts = kept(counts.select(*keys, F.ceil(F.col("_n") / tile).cast("int").alias("_k")), "tiles")
    sized = rows.join(counts, keys)
    chunk = F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    out = sized.withColumn("_chunk", chunk).withColumn("_other", other)
    a, b = F.least("_chunk", "_other"), F.greatest("_chunk", "_other")
    return out.withColumn("_tile", (a * F.col("_k") + b).cast("long")).withColumn("_right", (F.col("_chunk") > F.col("_other"))).drop("_chunk", "_other", "_k")


def near_links(nodes: DataFrame, radius: int = RADIUS, n: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints of ``nodes`` (fp, distinct) within the radius."""
    tables = keys_for(nodes.count() if n is None else n, radius)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("_table"), _key(F.col("fp"), parts).alias("_key")) for i, parts in enumerate(tables)]))
    rows = nodes.select("fp", keyed.alias("k")).select(F.col("fp").alias("id"), "k._table", "k._key")
    rows = tiled(rows, ["_table", "_key"], tile)
    group = F.xxhash64("_table", "_key", "_tile")  # only a name for the tile: a collision compares more, and changes nothing
    rows = rows.select("id", group.alias("g"), "_right")
    dealt = rows.repartition("g").sortWithinPartitions("g", "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, g, right in whole_groups(batches):
            root = links(fp.view(np.uint64), g, right, radius).root
            at = np.flatnonzero(root != np.arange(len(fp)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], names=["a", "b"])

    return map_texts(dealt, run, "a long, b long", 10_000)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole groups from batches sorted by their second column, of about ``rows`` rows or one group."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < rows:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[1], cols[1][-1], side="left"))
        if cut:
            yield tuple(c[:cut] for c in cols)
        held = [[c[cut:] for c in cols]]
        size = size - cut
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the smallest doc_id reachable over links)."""
    prints = kept(fingerprints(docs, shingle), "simhash-prints")
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), radius), "simhash-stars").select(F.col("node").alias("fp"), "root")
    linked = nodes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    of = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    of = kept(of, "simhash-components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id (null last); all columns kept."""
    key = F.xxhash64("doc_id", "text")
    prints = kept(fingerprints(docs.select(F.struct("doc_id", key.alias("k")).alias("doc_id"), "text"), shingle), "simhash-prints")
    order = F.struct(F.col("doc_id.doc_id").isNull().alias("a"), F.col("doc_id.doc_id").alias("b"), F.col("doc_id.k").alias("k"))
    nodes = kept(prints.groupBy("fp").agg(F.min(order).alias("first")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), radius), "simhash-stars").select(F.col("node").alias("fp"), "root")
    return one_of_each(docs, key, prints, nodes, roots, "fp")


def one_of_each(docs: DataFrame, key, prints: DataFrame, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """The rows of ``docs`` with the first place of each group of nodes; ``key`` names a row of prints in ``docs``."""
    name = free_name(docs, "key")
    stays = nodes.join(roots, node, "left").groupBy(F.coalesce("root", node).alias("root")).agg(F.min("first").alias("first"))
    stays = kept(stays.select(F.col("first.k").alias(name)), "dedup-stays")
    out = docs.withColumn(name, key).join(stays, name, "left_semi")
    # a row that is there twice with its doc_id and text stays once
    twice = prints.groupBy(F.col("doc_id.k").alias(name)).count().where("count > 1").select(name).join(stays, name, "left_semi")
    twice = kept(twice, "dedup-twice")
    if not twice.isEmpty():
        out = out.join(twice, name, "left_anti").unionByName(out.join(twice, name, "left_semi").dropDuplicates([name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
