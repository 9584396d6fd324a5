"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping windows (a short item is one window), of two lengths: the long ones allow more
edits at one place, the short ones catch excerpts. Any excerpt of ``SHORT + STEP - 1`` = 79 normalised characters (about
13 words) holds a whole short window, and is found if at most 6 edits fall in it; of 64 to 78 characters some are. A window of m characters that occurs in
a text with at most e edits shares at least m + 1 - q - q e of its character q-grams with it, all on diagonals (text
position less window position) within e of each other. Every text is passed over once for each block of windows: its
q-grams that the block holds are counted in bands of 2 (e + 1) diagonals that overlap by half, bands that meet the bound
are candidate regions, and a banded alignment verifies them. The windows of one block have a fixed total size, whatever
the benchmark's; each block is sent to all tasks in turn, and no text is ever joined or shuffled.

Texts are compared in lower case, with everything but letters and digits as single blanks. Defined results: null and
empty texts and items match nothing; items under ``q`` normalised characters are no evidence and match nothing; rows
that repeat a doc_id or an item_id are merged in the list of matches, while ``clean`` decides on every row; an empty
table on either side gives no match; extra columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, map_texts
from .hashing import BASE, mix, powers

Q = 8
WINDOW = 96
STRIDE = 48
#: Short windows, and how far apart they start.
SHORT = 64
STEP = 16
#: Edits for each character of a window.
RATE = 0.1
#: Characters of windows in one block.
BLOCK = 1_000_000
#: Characters of a text that are passed over at once.
SEGMENT = 200_000
BITS = 22

_BREAK = re.compile(r"[\W_]+")
_LATIN = bytes(ord(c.lower()) if c.isalnum() else 32 for c in map(chr, range(256)))


def normalise(text: str | None) -> str:
    try:  # a table of bytes is many times faster
        low = (text or "").encode("latin1").translate(_LATIN).decode("latin1")
    except UnicodeEncodeError:
        return _BREAK.sub(" ", text.lower()).strip()
    return " ".join(low.split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(text: str, window: int = WINDOW, stride: int = STRIDE) -> Iterator[str]:
    """Overlapping windows of a normalised text; the last one ends with it."""
    if len(text) <= window:
        yield text
        return
    for at in range(0, len(text) - window, stride):
        yield text[at : at + window]
    yield text[-window:]


def all_windows(text: str, window: int = WINDOW, stride: int = STRIDE, short: int = SHORT, step: int = STEP) -> list[str]:
    """The distinct windows of both lengths."""
    return [*dict.fromkeys([*windows(text, window, stride), *windows(text, short, step)])]


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Least edits of ``pattern`` against a stretch of ``text`` that starts at a diagonal from low to high.

    Dynamic programming over the diagonals low - budget to high + budget; returns (edits, end), or None over budget.
    """
    first, width = low - budget, high - low + 2 * budget + 1
    diagonal = np.arange(width)
    start = diagonal + first
    row = np.where((start >= 0) & (start <= len(text)), 0, budget + 1)
    padded = np.concatenate([text, np.zeros(1, np.uint32)])
    for i, c in enumerate(pattern):
        at = start + i  # the text position that pairs with this character on each diagonal
        inside = (at >= 0) & (at < len(text))
        pair = row + ~(inside & (padded[np.where(inside, at, -1)] == c))
        pair = np.where(inside, pair, budget + 1)
        skip = np.append(row[1:], budget) + 1  # the pattern's character is left out: one diagonal down
        best = np.minimum(pair, skip)
        # text characters left out: one diagonal up each
        row = np.minimum.accumulate(best - diagonal) + diagonal
        row = np.where((at + 1 >= 0) & (at + 1 <= len(text)), row, budget + 1)
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), int(start[k] + len(pattern))


def exact(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """(0, end) where the pattern itself starts at a diagonal from low to high: no alignment does better."""
    low = max(low, 0)
    stretch, wanted = text[low : max(high, 0) + len(pattern)].tobytes(), pattern.tobytes()
    at = stretch.find(wanted)
    while at >= 0 and at % 4:
        at = stretch.find(wanted, at + 1)
    return (0, low + at // 4 + len(pattern)) if at >= 0 else None


@dataclass
class Index:
    """The q-grams of a block of windows: each gram's (window, position) pairs, and a bitmap of the grams."""

    patterns: list[np.ndarray]
    items: list
    q: int
    rate: float

    def __post_init__(self) -> None:
        grams, owner, at = [], [], []
        for w, p in enumerate(self.patterns):
            g = gram_hashes(p, self.q)
            grams.append(g)
            owner.append(np.full(len(g), w))
            at.append(np.arange(len(g)))
        order = np.argsort(h := np.concatenate(grams), kind="stable")
        self.owner, self.at = np.concatenate(owner)[order], np.concatenate(at)[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.grams >> np.uint64(64 - BITS)] = True
        self.length = np.array([*map(len, self.patterns)])
        if self.length.max() > 1024:
            raise ValueError("windows of more than 1024 characters")
        self.budget = (self.rate * self.length).astype(np.int64)
        # where the bound would be void, fewer edits are allowed
        while (weak := self.length + 1 - self.q - self.q * self.budget < 1).any():
            self.budget[weak] -= 1
        self.least = self.length + 1 - self.q - self.q * self.budget

    def find(self, text: np.ndarray, segment: int = SEGMENT) -> list[tuple[int, int, int, int]]:
        """(window, start, end, edits) of the windows that occur in a normalised text, at the first place of each band."""
        lap = 4 * int(self.length.max())
        out: dict[int, tuple[int, int, int, int]] = {}
        for low in range(0, max(1, len(text) - lap), segment):
            part = text[low : low + segment + lap]
            for w, diagonal in self._regions(part):
                if w in out:
                    continue
                e = int(self.budget[w])
                found = exact(self.patterns[w], part, diagonal, diagonal + 2 * e + 1) or align(self.patterns[w], part, diagonal, diagonal + 2 * e + 1, e)
                if found:
                    end = low + found[1]
                    out[w] = (w, max(0, end - int(self.length[w])), end, found[0])
        return [*out.values()]

    def _regions(self, text: np.ndarray) -> list[tuple[int, int]]:
        """(window, first diagonal) of the bands that meet the window's bound."""
        h = gram_hashes(text, self.q)
        place = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITS)])
        h = h[place]
        at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        true = self.grams[at] == h
        place, at = place[true], at[true]
        if not len(place):
            return []
        n = self.count[at]
        pairs = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w = self.owner[pairs]
        # a window that the whole stretch doesn't hold often enough has no band that does
        often = np.bincount(w, minlength=len(self.patterns)) >= self.least
        own = np.flatnonzero(often[w])
        if not len(own):
            return []
        w, j = w[own], self.at[pairs[own]]
        diagonal = np.repeat(place, n)[own] - j
        band = diagonal // (self.budget[w] + 1)
        # shared q-grams of a band, each place of the window counted once
        key = np.concatenate([w, w]) << 42 | (np.concatenate([band, band - 1]) + (1 << 30)) << 10 | np.concatenate([j, j])
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] >> 10
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, hits = key[edge], np.diff(np.r_[edge, len(key)])
        w = key >> 32
        good = hits >= self.least[w]
        w, band = w[good], (key[good] & 0xFFFFFFFF) - (1 << 30)
        best = np.argsort(-hits[good], kind="stable")
        return [*zip(w[best].tolist(), (band * (self.budget[w] + 1))[best].tolist(), strict=True)]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of code points."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    up, down = powers(max(len(codes) + 1, 4096))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE ^ 0x5555555555555555) * up[: len(codes)], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * down[: len(codes) - q + 1])


def indexes(benchmark: DataFrame, q: int = Q, window: int = WINDOW, stride: int = STRIDE, short: int = SHORT, step: int = STEP, rate: float = RATE, block: int = BLOCK) -> Iterator[Index]:
    """The benchmark's windows in blocks of about ``block`` characters."""
    schema = T.StructType([benchmark.schema["item_id"], T.StructField("window", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [(i, w) for i, t in enumerate(b.column(1).to_pylist()) for w in all_windows(normalise(t), window, stride, short, step) if len(w) >= q]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in cut], pa.int64())), pa.array([w for _, w in cut], pa.string())], names=["item_id", "window"])

    rows = kept(map_texts(benchmark.select("item_id", "text"), cut, schema), "decontam-windows")
    chars = rows.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = -(-chars // block)
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == k).orderBy("item_id", "window").collect()
        if got:
            yield Index([_codes(r.window) for r in got], [r.item_id for r in got], q, rate)


def matches(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, n_windows, first_char, last_char, similarity): every item found in every text.

    Places are characters of the normalised text; similarity is that of the best window.
    """
    key, item = docs.schema["doc_id"], benchmark.schema["item_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item.dataType)
    schema = T.StructType([key, item, *[T.StructField(c, t) for c, t in (("n_windows", T.LongType()), ("first_char", T.LongType()), ("last_char", T.LongType()), ("similarity", T.DoubleType()))]])
    parts = []
    for index in indexes(benchmark, **how):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ix, rows = shared.value, []
                for i, t in enumerate(b.column(1).to_pylist()):
                    rows += [(i, ix.items[w], s, e, 1 - d / len(ix.patterns[w])) for w, s, e, d in ix.find(_codes(normalise(t)))]
                i, items, s, e, sim = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(items, item_type), pa.array([1] * len(i), pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(sim, pa.float64())], names=[f.name for f in schema])

        parts.append(map_texts(docs.select("doc_id", "text"), run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.min("first_char").alias("first_char"), F.max("last_char").alias("last_char"), F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item."""
    at = docs.columns.index("text")
    for index in indexes(benchmark, **how):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.find(_codes(normalise(t))) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = map_texts(docs, run, docs.schema)
    return docs
