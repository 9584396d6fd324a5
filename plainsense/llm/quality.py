"""Quality by perplexity under an interpolated modified Kneser-Ney character n-gram model of trusted text.

Trusted documents are those labelled good; one in five of them (by crc32 of doc_id) is left out of training and sets
the thresholds. N-gram counts are summed within tasks and then by Spark over shards of the n-gram; continuation counts,
context totals and discounts are aggregations of them. The events of all documents (their distinct n-grams) are joined
order by order to those count tables, from single characters up, which gives each event its interpolated probability.
Up to ``BROADCAST`` events, the table of probabilities goes to all tasks; beyond, documents are dealt to groups, and
every group gets the probabilities of its own n-grams by a join (``sharded``). Both ways give the same perplexities. A
document is kept if its perplexity is within its language's quantile of left-out trusted documents.

Texts are scored whole, blanks folded, between start and end marks. Defined results: a null or empty text is scored by
its end mark alone; a null language is a language of its own; languages with few left-out trusted documents use the
quantile of all of them; with no trusted document the model is uniform and every document is kept; rows that repeat are
scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, map_texts
from .decontam import _codes, gram_hashes

ORDER = 4
QUANTILE = 0.999
#: Left-out trusted documents that a language needs for a threshold of its own.
LEAST = 50
FOLDS = 5
#: Events up to which their probabilities are broadcast: about 40 bytes each while it is built.
BROADCAST = 2_000_000
#: Trusted doc_ids up to which they are broadcast (about 40 bytes each); beyond, the texts are shuffled to join them.
BROADCAST_IDS = 1_000_000
#: Documents of a group in the sharded way.
GROUP = 8192
START, END = "\x02", "\x03"

_BLANKS = re.compile(r"[\s\x00-\x1f]+")


def prepared(text: str | None, order: int) -> str:
    return START * (order - 1) + _BLANKS.sub(" ", text or "").strip() + END


class Counter:
    """Counts of n-grams within a task, merged as they come."""

    def __init__(self, order: int):
        self.order, self.parts, self.size = order, [], 0

    def add(self, texts: list[str]) -> None:
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        ok = np.ones(len(codes), bool)
        for k in range(1, self.order):  # n-grams that run into the next text
            ok[ends - k] = False
        ok = np.flatnonzero(ok[: len(codes) - self.order + 1])
        h, first, n = np.unique(gram_hashes(codes, self.order)[ok], return_index=True, return_counts=True)
        grams = codes[ok[first][:, None] + np.arange(self.order)]
        self.parts.append((h, grams, n))
        self.size += len(h)
        if self.size > 1_500_000:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            h, grams, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            self.parts = [(h, grams[first], np.bincount(inverse, n).astype(np.int64))]
        self.size = sum(len(p[0]) for p in self.parts)

    def table(self) -> tuple[list[str], np.ndarray]:
        self.merge()
        if not self.parts:
            return [], np.zeros(0, np.int64)
        _, grams, n = self.parts[0]
        text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[i : i + self.order] for i in range(0, len(text), self.order)], n


def _texts(values: list[str | None], order: int, size: int = 1_000_000) -> Iterator[list[str]]:
    held, n = [], 0
    for v in values:
        held.append(t := prepared(v, order))
        n += len(t)
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def grams(docs: DataFrame, order: int) -> DataFrame:
    """(gram, n) of ``docs`` (text): one row at most for each gram and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(order)
        for b in batches:
            for texts in _texts(b.column(0).to_pylist(), order):
                count.add(texts)
        found, n = count.table()
        for i in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["gram", "n"])

    return map_texts(docs.select("text"), run, "gram string, n long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; where those don't give any, half a count."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), cap - 0.05) for d, cap in ((d1, 1), (d2, 2), (d3, 3)))


def probabilities(counts: DataFrame, events: DataFrame, order: int) -> DataFrame:
    """(gram, p) of every event (gram) under the model of ``counts`` (gram, n)."""
    a = {order: counts.select("gram", F.col("n").alias("a"))}
    wanted = {order: events.select("gram")}
    for k in range(order - 1, 0, -1):
        rest = F.substring("gram", 2, k).alias("gram")
        a[k] = kept(a[k + 1].select(rest).groupBy("gram").agg(F.count(F.lit(1)).alias("a")), "quality-continuations")
        wanted[k] = kept(wanted[k + 1].select(rest).distinct(), "quality-events")
    letters = a[1].count() + 1
    p = wanted[1].select(F.lit("").alias("gram")).distinct().select("gram", F.lit(1.0 / letters).alias("p"))
    for k in range(1, order + 1):
        of = a[k].agg(*[F.count(F.when(F.col("a") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(*of)
        d = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        contexts = a[k].withColumn("context", context).groupBy("context").agg(F.sum("a").alias("total"), (F.sum(d) / F.sum("a")).alias("spare"))
        own = wanted[k].withColumn("context", context).withColumn("rest", F.substring("gram", 2, k - 1) if k > 1 else F.lit(""))
        own = own.join(a[k], "gram", "left").join(contexts, "context", "left").join(p.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest")
        seen = F.coalesce((F.col("a") - d) / F.col("total"), F.lit(0.0))
        p = kept(own.select("gram", (seen + F.coalesce("spare", F.lit(1.0)) * F.col("lower")).alias("p")), "quality-p")
    return p


def _score(values: list[str | None], known: np.ndarray, nll: np.ndarray, order: int) -> list[tuple[int, float]]:
    out = []
    for texts in _texts(values, order):
        codes = _codes("".join(texts))
        at = np.searchsorted(known, gram_hashes(codes, order))
        each = nll[np.minimum(at, len(nll) - 1)]
        sums = np.concatenate([[0.0], np.cumsum(each)])
        low = 0
        for t in texts:
            n = len(t) - order + 1
            out.append((n, float(np.exp((sums[low + n] - sums[low]) / n))))
            low += len(t)
    return out


def _sorted_table(found: list[str], p: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    h = gram_hashes(_codes("".join(found)), order)[::order]
    by = np.argsort(h)
    return h[by], -np.log(p[by])


def _in_groups(docs: DataFrame, groups: int) -> DataFrame:
    return docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))


def perplexities(docs: DataFrame, counts: DataFrame, order: int = ORDER, broadcast: int = BROADCAST, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, lang, n_events, perplexity."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("n_events", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    names = [f.name for f in schema]
    docs = docs.select("doc_id", "lang", "text")
    events = kept(grams(docs, order).select("gram").distinct(), "quality-grams")
    p = probabilities(counts, events, order)

    def rows(b: pa.RecordBatch | pa.Table, known: np.ndarray, nll: np.ndarray) -> list[pa.Array]:
        n, x = zip(*_score(b.column("text").to_pylist(), known, nll, order), strict=True)
        return [b.column("doc_id"), b.column("lang"), pa.array(n, pa.int64()), pa.array(x, pa.float64())]

    if events.count() <= broadcast:
        table = p.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(_sorted_table(table.column("gram").to_pylist(), table.column("p").to_numpy(), order))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays(rows(b, *shared.value), names=names)

        return map_texts(docs, run, schema)
    groups = max(1, -(-docs.count() // group))
    grouped = _in_groups(docs, groups)

    def distinct(t: pa.Table) -> pa.Table:
        count = Counter(order)
        for texts in _texts(t.column("text").to_pylist(), order):
            count.add(texts)
        found, _ = count.table()
        return pa.table({"g": pa.array(np.full(len(found), t.column("g")[0].as_py())), "gram": pa.array(found, pa.string())})

    own = grouped.select("g", "text").groupBy("g").applyInArrow(distinct, "g long, gram string").join(p, "gram")

    def score(t: pa.Table, table: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(["doc_id", "lang"]).append_column("n_events", pa.array([], pa.int64())).append_column("perplexity", pa.array([], pa.float64()))
        return pa.table(dict(zip(names, rows(t, *_sorted_table(table.column("gram").to_pylist(), table.column("p").to_numpy(), order)), strict=True)))

    return grouped.groupBy("g").cogroup(own.select("g", "gram", "p").groupBy("g")).applyInArrow(score, schema)


def _left_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, least: int = LEAST, **how) -> DataFrame:
    """One row per document: doc_id, lang, n_events, perplexity, threshold, kept."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = kept(good.where(~_left_out(F.col("doc_id"))), "quality-trusted")
    trusted = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "doc_id", "left_semi")
    counts = kept(grams(trusted, order).groupBy("gram").agg(F.sum("n").alias("n")), "quality-counts")
    scored = kept(perplexities(docs, counts, order, **how), "quality-scores")
    held = scored.join(good.where(_left_out(F.col("doc_id"))), "doc_id", "left_semi")
    top = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    by = held.groupBy("lang").agg(top.alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("lang").alias("of"), "own")
    overall = held.agg(top).first()[0]
    limit = F.coalesce("own", F.lit(overall).cast("double"), F.lit(float("inf")))
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("threshold", limit)
    return out.select("doc_id", "lang", "n_events", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
