"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of surviving groups.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Each level is
a count over narrow rows, and only what a level leaves enters the next: prefixes are hashed for rows whose length occurs
more than once, whole contents for rows whose length and prefix do. The texts themselves are never shuffled.

Defined results: a null text is the empty text (all empty texts are one group); rows that repeat a doc_id within a
group share one decision (both carry the same keep_id); a null doc_id loses every tie and a group of only null ids has
a null keep_id and keeps its rows; an empty table gives an empty result; columns beyond ``doc_id`` and ``text`` are
ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import kept

#: Surviving keys of a level are broadcast up to this many (24 bytes each: 24 MB); beyond it hashes are joined.
BROADCAST_KEYS = 1_000_000
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without blanks and line ends."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _marked(rows: DataFrame, survivors: DataFrame, keys: list[str], flag: str, limit: int) -> DataFrame:
    """``rows`` with a flag that tells whether their keys survive; ``survivors`` is a written table of distinct keys."""
    survivors = survivors.select(*keys, F.lit(True).alias(flag))
    return rows.join(F.broadcast(survivors) if survivors.count() <= limit else survivors, keys, "left")


def exact_dedup(docs: DataFrame, carry: dict[str, Column] | None = None, prefix_chars: int = PREFIX_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the ``carry`` expressions (over doc_id, text, norm).

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id.
    """
    carry = carry or {}
    rows = docs.select("doc_id", "text").withColumn("norm", normalised(F.col("text")))
    rows = rows.withColumn("norm_len", F.octet_length("norm").cast("long"))
    # level 1: a length that occurs once ends there
    lengths = kept(rows.groupBy("norm_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "exact-lengths")
    # level 2: so does a prefix that occurs once among the texts of its length
    some = lengths.count() <= broadcast_keys
    prefix = F.xxhash64(F.substring("norm", 1, prefix_chars))
    if some:
        rows = _marked(rows, lengths, ["norm_len"], "again", broadcast_keys).withColumn("prefix", F.when(F.col("again"), prefix)).drop("again")
    else:  # more lengths than can be broadcast: a prefix is cheaper than a join of the texts
        rows = rows.withColumn("prefix", prefix)
    pairs = rows.where("prefix is not null").groupBy("norm_len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = kept(pairs, "exact-pairs")
    # level 3: whole contents of the rest
    full = F.sha2(F.col("norm"), 256)
    narrow = ["doc_id", F.length("text").alias("n_cp"), "norm_len"]
    extra = [c.alias(k) for k, c in carry.items()]
    if pairs.count() <= broadcast_keys:
        rows = _marked(rows, pairs, ["norm_len", "prefix"], "again", broadcast_keys).select(*narrow, F.when(F.col("again"), full).alias("full"), *extra)
    else:  # the texts don't travel: their hashes do
        rows = rows.select(*narrow, "prefix", full.alias("full"), *extra)
        rows = _marked(rows, pairs, ["norm_len", "prefix"], "again", 0).withColumn("full", F.when(F.col("again"), F.col("full"))).drop("prefix", "again")
    rows = kept(rows.withColumn("n_cp", F.coalesce("n_cp", F.lit(0))), "exact-rows")
    # the groups' rows are summed before they are shuffled, and written before they are joined: both sides of the join
    # are plain shuffles, and Spark splits a group that holds a large part of all rows
    order = F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = rows.where("full is not null").groupBy("norm_len", "full").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = kept(groups.where("group_size > 1").select("norm_len", "full", F.col("best.c").alias("keep_id"), "group_size"), "exact-groups")
    out = rows.where("full is not null").join(groups, ["norm_len", "full"], "left").unionByName(rows.where("full is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), *carry)
