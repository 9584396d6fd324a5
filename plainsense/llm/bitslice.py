"""Bit-sliced Hamming comparison: bit planes stored vertically, carry-save counters, blocks abandoned early."""

from __future__ import annotations

import numpy as np

#: Comparisons (a query against a word of up to 64 fingerprints) made at once: bounds the memory of the answer.
CHUNK = 40_000


def planes_of(prints: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of words of up to 64 fingerprints: (bits, words), and the valid lanes of each word.

    Word w holds prints[starts[w] : starts[w] + counts[w]]; lane i of plane b is bit b of its i-th fingerprint.
    A fingerprint has 64 bits, or is a row of several words of 64 bits.
    """
    words = len(starts)
    lane = np.arange(64)
    at = np.minimum(starts[:, None] + lane, len(prints) - 1)
    bits = np.unpackbits(prints[at].astype("<u8").view(np.uint8).reshape(words, 64, -1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    full = counts >= 64
    valid = np.where(full, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.where(full, 0, counts).astype(np.uint64)) - np.uint64(1))
    return planes, valid


def within(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries (query fingerprint, word index): entries with a lane within the radius, and those lanes as bits.

    A counter of carry-save bits for each lane counts differing planes; a lane whose count passes the radius stays
    marked; every eighth plane, entries whose lanes are all marked are abandoned.
    """
    live = np.arange(len(queries))
    q, w = queries, words
    digits = radius.bit_length()
    over = ~valid[w]
    start = (1 << digits) - 1 - radius  # counting from here, the counter overflows past the radius
    sums = [np.full(len(q), 0xFFFFFFFFFFFFFFFF if start >> d & 1 else 0, np.uint64) for d in range(digits)]
    for b in range(len(planes)):
        flip = np.uint64(0) - (((q if q.ndim == 1 else q[:, b // 64]) >> np.uint64(b % 64)) & np.uint64(1))
        carry = planes[b][w] ^ flip
        for d in range(digits):
            sums[d], carry = sums[d] ^ carry, sums[d] & carry
        over |= carry
        if b % 8 == 7:
            go = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not go.all():
                live, q, w, over, sums = live[go], q[go], w[go], over[go], [s[go] for s in sums]
            if not len(live):
                break
    return live, ~over


class Forest:
    """Union-find over row numbers, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root = jumped
            self.root = root


def links(prints: np.ndarray, group: np.ndarray, right: np.ndarray, radius: int) -> Forest:
    """Joins rows of one group within the radius; rows are sorted by (group, right).

    A group with rows on both sides is compared across the sides only; any other group within itself.
    """
    n = len(prints)
    forest = Forest(n)
    if n < 2:
        return forest
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[edge, n])
    n_right = np.add.reduceat(right.astype(np.int64), edge)
    two = (n_right > 0) & (n_right < size)
    # the compared-against side of each group: its right rows, or all of them
    first, count = np.where(two, edge + size - n_right, edge), np.where(two, n_right, size)
    asked = np.where(two, size - n_right, size)
    busy = (count > 0) & (asked > 0) & (size > 1)
    edge, first, count, asked = edge[busy], first[busy], count[busy], asked[busy]
    if not len(edge):
        return forest
    per = -(-count // 64)
    word_of = np.repeat(np.arange(len(edge)), per)
    nth = np.arange(len(word_of)) - np.repeat(np.cumsum(per) - per, per)
    starts = first[word_of] + 64 * nth
    counts = np.minimum(64, count[word_of] - 64 * nth)
    base = np.cumsum(per) - per
    todo = asked * per  # entries of each group
    ends = np.cumsum(todo)
    for low in range(0, int(ends[-1]), CHUNK):
        e = np.arange(low, min(low + CHUNK, int(ends[-1])))
        g = np.searchsorted(ends, e, side="right")
        k = e - (ends[g] - todo[g])
        row, word = edge[g] + k // per[g], base[g] + k % per[g]
        used, word = np.unique(word, return_inverse=True)
        if prints.ndim > 1:  # at a wide radius most of a group is one already: words that hold nothing new are left out
            lanes = forest.root[starts[used][:, None] + np.minimum(np.arange(64), counts[used][:, None] - 1)]
            new = (lanes.min(1)[word] != forest.root[row]) | (lanes.max(1)[word] != forest.root[row])
            if not new.any():
                continue
            row = row[new]
            kept, word = np.unique(word[new], return_inverse=True)
            used = used[kept]
        planes, valid = planes_of(prints, starts[used], counts[used])
        hit, lanes = within(prints[row], word, planes, valid, radius)
        if not len(hit):
            continue
        bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        a, b = row[hit[i]], starts[used[word[hit[i]]]] + lane
        forest.join(a[a != b], b[a != b])
    return forest
