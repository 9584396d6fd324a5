"""Removes every byte covered by a long string that also starts elsewhere: sampled prefix doubling over suffix positions.

Doubling ranks of all suffixes would sort every byte of the corpus in every round. A content-defined sample of the
positions is enough for a threshold of ``length`` bytes: a position is sampled when the hash of its first ``first``
bytes is the least among all windows of ``length`` bytes around some start (a minimizer). Equal strings of ``length``
bytes hold equal sampled positions at equal offsets, so every repeat shows at a sampled position.

1. Rank: Spark groups sampled positions by the hash of ``first`` bytes; unique positions leave.
2. Double: survivors are reranked by the pair (that rank, rank of the surrounding bytes up to ``length`` from either
   end). Positions with one surrounding end here: all strings of ``length`` bytes through them repeat.
3. Positions whose rank repeats with different surroundings: one representative of each surrounding is reranked by the
   pairs (left part, right part) that make up each string of ``length`` bytes through it. Groups of bounded size are
   reranked in one task; larger ones rerank by half the reach first and send the pairs of what is left through a Spark
   aggregation.
4. Each sampled position now has the outermost repeated strings through it; they overlap, so together they are one
   run of bytes. Runs are joined to the texts and removed at once.

Hashes are 64 bits wide. Defined results: a null text is empty and has the hash of no bytes; texts under ``length``
bytes are unchanged; rows that repeat both doc_id and text repeat each other's strings; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, map_texts
from .hashing import BASE, VALUE, mix, powers, slide, sums_of
from .simhash import whole_groups

LENGTH = 200
FIRST = 50
#: Bytes of a text whose positions are sampled at once.
SEGMENT = 1_000_000
#: Surroundings of one rank that are reranked in one task.
GROUP = 20_000

def sample(data: np.ndarray, length: int = LENGTH, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a text, the hashes of their first bytes, and the hashes of their surroundings."""
    n, reach = len(data), length - first
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = sums_of(data)
    _, down = powers(len(sums))
    h = mix((sums[first:] - sums[:-first]) * down[: n - first + 1])
    least = slide(h, reach + 1, np.minimum)  # of each window, by its start
    rim = np.zeros(reach, np.uint64)
    most = slide(np.concatenate([rim, least, rim]), reach + 1, np.maximum)  # of the windows around each position
    at = np.flatnonzero(most == h)
    a, b = np.maximum(at - reach, 0), np.minimum(at + length, n)
    around = mix((sums[b] - sums[a]) * down[a] + ((at - a) * 1009 + (b - at)).astype(np.uint64) * np.uint64(BASE))
    return at, h[at], around


def sampled(data: np.ndarray, length: int = LENGTH, first: int = FIRST, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``sample`` by segments that see enough of their neighbours."""
    if len(data) <= segment + 2 * length:
        yield sample(data, length, first)
        return
    for low in range(0, len(data), segment):
        a, b = max(0, low - length), min(len(data), low + segment + length)
        at, h, around = sample(data[a:b], length, first)
        own = (at + a >= low) & (at + a < low + segment)
        yield at[own] + a, h[own], around[own]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def positions(docs: DataFrame, length: int, first: int, ranks_only: bool = False) -> DataFrame:
    """(key, pos, rank, around) of every sampled position of ``docs`` (key, text); only rank with ``ranks_only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for key, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for at, h, around in sampled(data, length, first):
                    parts.append((np.full(len(at), key), at, h.view(np.int64), around.view(np.int64)))
                    size += len(at)
                if size > 500_000:
                    yield out(parts)
                    parts, size = [], 0
            if size:
                yield out(parts)

    def out(parts: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[2])], names=["rank"]) if ranks_only else pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["key", "pos", "rank", "around"])

    return map_texts(docs.select("key", "text"), run, "rank long" if ranks_only else "key long, pos long, rank long, around long")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as zstd blobs: (doc_id, key, blob); they travel in two joins."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press(t.as_buffer()) for t in b.column(2)], pa.binary())], names=["doc_id", "key", "blob"])

    return map_texts(docs.select("doc_id", "key", "text"), run, schema)


def _surroundings(docs: DataFrame, reps: DataFrame, length: int, first: int) -> DataFrame:
    """(rank, around, n, left, right): the bytes on both sides of each representative's first bytes."""
    reach = length - first
    wanted = reps.groupBy("key").agg(F.collect_list(F.struct("pos", "rank", "around", "n")).alias("at"))
    one = _packed(docs).join(wanted, "key").select("blob", "at.pos", "at.rank", "at.around", "at.n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            rows = []
            for blob, pos, rank, around, n in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                text = zstandard.ZstdDecompressor().decompress(blob)
                rows += [(r, a, k, text[max(0, p - reach) : p], text[p + first : p + length]) for p, r, a, k in zip(pos, rank, around, n, strict=True)]
            cols = [*zip(*rows, strict=True)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["rank", "around", "n", "left", "right"])

    # equal rows (repeated documents) give a representative twice
    return map_texts(one, run, "rank long, around long, n long, left binary, right binary", 200).dropDuplicates(["rank", "around"])


def _side_sums(lefts: list[bytes], rights: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the last d bytes of each left side and the first d of each right one, d from 0 to reach; the sides' lengths."""
    m = len(lefts)
    up, _ = powers(4096)
    sums = []
    for side in ([x[::-1] for x in lefts], rights):
        data = np.frombuffer(b"".join(x.ljust(reach, b"\0") for x in side), np.uint8).reshape(m, reach)
        s = np.zeros((m, reach + 1), np.uint64)
        np.cumsum(VALUE[data] * up[:reach], axis=1, out=s[:, 1:])
        sums.append(s)
    return sums[0], sums[1], np.array([*map(len, lefts)]), np.array([*map(len, rights)])


def _pairs(rank: np.ndarray, sides: tuple, reach: int, ds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each d of ``ds``: the rank of (last d bytes of left, first reach - d of right), and whether there is one."""
    left, right, ln, rn = sides
    there = (ds <= ln[:, None]) & (reach - ds <= rn[:, None])
    salt = mix(ds.astype(np.uint64) + np.uint64(77))
    pairs = mix(left[:, ds]) + right[:, reach - ds] * np.uint64(BASE) + salt
    return mix(mix(pairs) + rank.view(np.uint64)[:, None]), there


def _small_groups(sides: DataFrame, reach: int) -> DataFrame:
    """(rank, around, low, high): the least and greatest d whose string repeats, of groups that fit one task."""
    dealt = sides.select("around", "rank", "left", "right").repartition("rank").sortWithinPartitions("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for around, rank, left, right in whole_groups(batches, 4000):
            hashed = _side_sums([*left], [*right], reach)
            low, high = np.full(len(rank), reach + 1), np.full(len(rank), -1)
            step = max(1, 500_000 // len(rank))
            for at in range(0, reach + 1, step):  # strings at different d are never equal
                ds = np.arange(at, min(at + step, reach + 1))
                pairs, there = _pairs(rank, hashed, reach, ds)
                row, d = np.nonzero(there)
                _, inverse, count = np.unique(pairs[row, d], return_inverse=True, return_counts=True)
                again = count[inverse] > 1
                np.minimum.at(low, row[again], ds[d[again]])
                np.maximum.at(high, row[again], ds[d[again]])
            hit = high >= 0
            yield pa.RecordBatch.from_arrays([*map(pa.array, (rank[hit], around[hit], low[hit], high[hit]))], names=["rank", "around", "low", "high"])

    return map_texts(dealt, run, "rank long, around long, low long, high long")


def _large_groups(sides: DataFrame, reach: int) -> DataFrame:
    """As ``_small_groups``, for ranks with very many surroundings: ranks and pairs as rows, counted by Spark.

    A string through a position holds at least half of the reach on one side. So positions are first reranked by that
    half on either side; those that are unique on both sides leave, and only the others give their pairs.
    """
    half = reach - reach // 2

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(0).to_numpy()
            left, right, ln, rn = _side_sums(b.column(2).to_pylist(), b.column(3).to_pylist(), reach)
            cols = [mix(mix(s[:, half] + np.uint64(k)) + rank.view(np.uint64)).view(np.int64) for k, s in enumerate((left, right))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(ln >= half, cols[0], 0), mask=ln < half), pa.array(np.where(rn >= half, cols[1], 0), mask=rn < half)], names=["rank", "around", "l", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, around = b.column(0).to_numpy(), b.column(1).to_numpy()
            pairs, there = _pairs(rank, _side_sums(b.column(2).to_pylist(), b.column(3).to_pylist(), reach), reach, np.arange(reach + 1))
            row, d = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (rank[row], around[row], d, pairs[row, d].view(np.int64)))], names=["rank", "around", "d", "pair"])

    large = sides.select("rank", "around", "left", "right")
    half_ranks = kept(map_texts(large, halves, "rank long, around long, l long, r long"), "suffix-halves")
    sided = half_ranks.select("rank", "around", F.explode(F.array("l", "r")).alias("h")).where("h is not null")
    again = sided.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    alive = sided.join(again, "h", "left_semi").select("rank", "around").distinct()
    pairs = kept(map_texts(large.join(alive, ["rank", "around"], "left_semi").select("rank", "around", "left", "right"), run, "rank long, around long, d long, pair long"), "suffix-pairs")
    twice = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("pair")
    return pairs.join(twice, "pair", "left_semi").groupBy("rank", "around").agg(F.min("d").alias("low"), F.max("d").alias("high"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, first: int = FIRST, group: int = GROUP) -> DataFrame:
    """(key, runs: array of (start, end)) of ``docs`` (doc_id, key, text) with a repeated string; runs may overlap."""
    reach = length - first
    # what is joined on the key it was grouped by is written first: a rank that very many positions have can be split then
    ranks = kept(positions(docs, length, first, ranks_only=True).groupBy("rank").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rank"), "suffix-ranks")
    alive = kept(positions(docs, length, first).join(ranks, "rank", "left_semi"), "suffix-alive")
    pairs = kept(alive.groupBy("rank", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("rep")), "suffix-pairs")
    several = kept(pairs.groupBy("rank").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "suffix-several")
    reps = pairs.join(several, "rank").select("rank", "around", "n", "rep.key", "rep.pos", "m")
    sides = _surroundings(docs, reps, length, first)
    sides = kept(sides.join(several, "rank"), "suffix-sides")
    ends = _small_groups(sides.where(F.col("m") <= group), reach)
    if not several.where(F.col("m") > group).isEmpty():
        ends = ends.unionByName(_large_groups(sides.where(F.col("m") > group), reach))
    # a surrounding that occurs twice repeats whole: the final step knows how far it reaches
    known = pairs.select("rank", "around", "n").join(ends, ["rank", "around"], "left").where("n > 1 or high is not null")
    known = known.select("rank", "around", F.when(F.col("n") > 1, F.lit(0)).otherwise(F.col("low")).alias("low"), F.when(F.col("n") > 1, F.lit(reach)).otherwise(F.col("high")).alias("high"))
    known = kept(known, "suffix-known")
    found = alive.join(known, ["rank", "around"]).select("key", F.struct((F.col("pos") - F.col("high")).alias("start"), (F.col("pos") + length - F.col("low")).alias("end")).alias("run"))
    # rows that repeat a document give its runs again: each counts once
    return found.groupBy("key").agg(F.collect_set("run").alias("runs"))


def cut_runs(docs: DataFrame, runs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the rest (kept_bytes)."""
    joined = _packed(docs).join(runs, "key", "left").select("doc_id", "blob", "runs.start", "runs.end")
    fields = [docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept_bytes", T.BinaryType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            rows = []
            for blob, start, end in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                text, left, at, spans = zstandard.ZstdDecompressor().decompress(blob), [], 0, 0
                for s, e in sorted(zip(start or (), end or (), strict=True)):
                    s, e = max(s, 0), min(e, len(text))
                    if s > at or not spans:
                        left.append(text[at:s])
                        spans += 1
                        at = e
                    at = max(at, e)
                left.append(text[at:])
                rest = b"".join(left)
                rows.append((len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest)[: 4 + with_text])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 3 + (pa.string(), pa.binary()), strict=False)]], names=[f.name for f in schema]) if rows else b.slice(0, 0)

    return map_texts(joined, run, schema, 500)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, first: int = FIRST, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """Removes from every text the bytes covered by a ``length``-byte string that also starts anywhere else."""
    keyed = _keyed(docs)
    return cut_runs(keyed, repeated_runs(keyed, length, first, group), with_text)
