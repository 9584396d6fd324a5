"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, word pairs and pairs with one word between (32-bit hash space). The labelled
rows are a bounded sample: those with the least hash of doc_id, up to ``MAX_TRAIN`` documents that have ``MAX_FEATURES``
features between them (the same ones in every run, however the data are partitioned); one task learns from them in
repeated online passes with per-coordinate rates, and its L1 term leaves few weights other than zero: hash and weight
arrays, bounded by the sample, that every scoring task gets. All documents are scored whole, in one narrow pass.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. The score depends on the text alone.

Defined results: a null or empty text scores as a text with no features (the intercept); labels that are null or other
than 0 and 1 are not learnt from, nor are rows with a null doc_id; with no usable label every score is the same and
under 0.001; rows that repeat are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_texts
from .hashing import mix, word_hashes

MAX_TRAIN = 12_000
#: Features of the sample, 4 bytes each, which the training task holds. Texts of 1,000 words reach MAX_TRAIN first.
MAX_FEATURES = 40_000_000
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """FTRL-proximal: rate alpha / (beta + sqrt(sum of squared gradients)), L1 and L2 terms, and the passes."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 15.0
    l2: float = 0.1
    examples: int = 30_000
    most_passes: int = 30
    min_rows: int = 5


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, by feature hash."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = features(t)
            at = np.minimum(np.searchsorted(self.keys, f), max(len(self.keys) - 1, 0))
            found = at[self.keys[at] == f] if len(self.keys) else at[:0]
            out[i] = self.intercept + self.weights[np.unique(found)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def features(text: str | None) -> np.ndarray:
    """Hashes of the words, pairs and skip pairs of a text, repeats included."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    pair = mix(w[:-1] * np.uint64(3) + w[1:]) if len(w) > 1 else w[:0]
    skip = mix(w[:-2] * np.uint64(5) + w[2:]) if len(w) > 2 else w[:0]
    return (np.concatenate([w, pair, skip]) >> np.uint64(32)).astype(np.uint32)


def train(rows: list[tuple[np.ndarray, int]], s: Settings = Settings()) -> Model:
    """Learns from (distinct feature hashes, label) rows; features of fewer than ``min_rows`` rows are left out."""
    if not rows:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -np.inf)
    known, seen = np.unique(np.concatenate([f for f, _ in rows]), return_counts=True)
    known = known[seen >= s.min_rows]
    ids = []
    for f, y in rows:
        at = np.searchsorted(known, f)
        at[at == len(known)] = 0
        ids.append((at[known[at] == f] if len(known) else at[:0], y))
    z, n, w = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    last = len(known)  # the intercept: no L1
    passes = min(s.most_passes, max(2, -(-s.examples // len(rows))))
    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(ids)):
            at, y = ids[k]
            at = np.append(at, last)
            wi = w[at]
            p = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35)))
            g = p - y
            ni = n[at]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            zi = z[at] + g - sigma * wi
            ni = ni + g * g
            l1 = np.full(len(at), s.l1)
            l1[-1] = 0
            w[at] = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            z[at], n[at] = zi, ni
    kept = np.flatnonzero(w[:last])
    return Model(known[kept], w[kept], float(w[last]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, settings: Settings = Settings(), max_features: int = MAX_FEATURES) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", "toxic").distinct()
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("a"), F.xxhash64("doc_id", "text").alias("b"), F.col("toxic").cast("int").alias("toxic"), "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [np.unique(features(t)).tobytes() for t in x.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(found, pa.binary())], names=["a", "b", "toxic", "f"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:  # in the order of the hashes: the sample ends where either bound is reached
            for y, f in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                size += len(f) // 4
                if len(held) < max_train and size <= max_features:
                    held.append((np.frombuffer(f, np.uint32), y))
        m = train(held, settings)
        yield pa.RecordBatch.from_arrays([pa.array([m.keys.tobytes()]), pa.array([m.weights.tobytes()]), pa.array([m.intercept])], names=["keys", "weights", "intercept"])

    found = map_texts(rows, distinct, "a long, b long, toxic int, f binary", 200).repartition(1).sortWithinPartitions("a", "b", "toxic").select("toxic", "f")
    got = map_texts(found, fit, "keys binary, weights binary, intercept double", 200).collect()  # one row
    if not got:
        return train([])
    return Model(np.frombuffer(got[0].keys, np.uint32), np.frombuffer(got[0].weights), got[0].intercept)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.score(b.column(2).to_pylist()))], names=["doc_id", "held_out", "score"])

    scored = map_texts(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, settings: Settings = Settings()) -> DataFrame:
    """Learns from the labelled rows and scores every document."""
    return score_documents(docs, learn(docs, labels, max_train, settings))


def reject_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, max_train: int = MAX_TRAIN, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_train, settings))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) < limit))

    return map_texts(docs, run, docs.schema)
