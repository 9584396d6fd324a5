"""Vectorised 64-bit hashing of byte ranges and words."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby inputs give unrelated values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15
VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            _tables.append(np.multiply.accumulate(step))
    return _tables[0], _tables[1]


def sums_of(data: np.ndarray) -> np.ndarray:
    """Prefix sums of value x power: the hash of data[a:b] is (sums[b] - sums[a]) / power[a], modulo 2**64."""
    up, _ = powers(max(len(data) + 1, 4096))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * up[: len(data)], out=out[1:])
    return out


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each window of w values."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, x[-1], x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


#: Bytes of a text that are hashed at once.
SEGMENT = 1_000_000


def word_table() -> np.ndarray:
    """Word bytes: ASCII letters and digits, and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    for low, high in ((48, 57), (97, 122), (128, 255)):
        table[low : high + 1] = True
    return table


_WORD = word_table()


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word of a text that is already in lower case, in order."""
    return words_and_sizes(text)[0]


def words_and_sizes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, in order, and their lengths in bytes."""
    data = np.frombuffer(text, np.uint8)
    out, sizes, low = [], [], 0
    while low < len(data):
        high = min(len(data), low + SEGMENT)
        while high < len(data) and _WORD[data[high]] and _WORD[data[high - 1]]:  # not within a word
            step = np.flatnonzero(~_WORD[data[high : high + SEGMENT]])
            high = high + int(step[0]) if len(step) else min(len(data), high + SEGMENT)
        part = data[low:high]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = _WORD[part]
        turn = np.diff(inside)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = sums_of(part)
        _, down = powers(len(sums))
        out.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        sizes.append(end - start)
        low = high
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
