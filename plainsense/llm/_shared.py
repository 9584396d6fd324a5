"""Helpers shared by the training-data operators: input tables, shared-folder tables, Arrow batches of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import kept, materialize, remove
from ..shipping import ship

__all__ = ["free_name", "kept", "map_texts", "materialize", "remove", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, fn, schema, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(fn, schema)
