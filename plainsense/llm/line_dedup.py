"""Fuzzy line dedup: SimHash of normalised lines, joined on pigeonhole blocks, verified by edit similarity.

A line is normalised to lower case with digits as 0 and everything but letters and digits as single blanks. Equal
normalised lines are one node with a count and a first place.

One SimHash of a whole line can't find lines of an edit similarity of 0.8: a changed word in ten turns some ten of its
64 bits. So a line is cut into overlapping parts of its words, each part has a SimHash of its own, and these are the
pigeonhole blocks: a changed word spoils the parts that it is in, and two lines are compared when any part is equal.
Lines of up to ``SHORT`` words have the parts that leave one word out (and the whole); lines of ``LEAST`` words or more
have ``PARTS`` parts of ``SPAN`` words each, those with the least values under as many hash orders, longer words first.

Parts travel as packed pairs (part, line hash) by key range; a task keeps each part's first line and gives out the parts
that a second line has. Lines of a common part are brought together with their texts, in tiles of bounded size. Pairs
whose whole-line SimHashes (128 bits) lie within ``RADIUS`` are verified by edit distance unless they are connected
already, each in the least block that both have (a bound from the words that both have in the same order settles most
without it; the edit distances of the rest are taken side by side in the lanes of one number). Of every
connected group of verified (or equal) lines the first occurrence, by doc_id and line number, stays; the others are
removed from their texts.

Defined results: blank lines and lines under ``min_chars`` normalised characters stay; digits are alike, but lines with
more digits than other characters keep theirs; a line of one word has only equal lines; a text may lose all its lines
and becomes empty, its row stays; a null text stays null; rows that repeat both doc_id and text are one document and
keep the same lines; a null doc_id comes after all others; an empty table gives an empty result; all columns of the
input are kept whatever their names, ``text`` alone is changed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from ._shared import free_name, kept, map_texts
from .bitslice import Forest
from .components import components
from .hashing import mix, words_and_sizes
from .simhash import tiled, whole_groups

SIMILARITY = 0.8
MIN_CHARS = 8
#: Parts of a line, and the words in each.
PARTS = 6
SPAN = 4
#: Lines of up to so many words have the parts that leave one word out; lines from LEAST words on have the others.
SHORT = 12
LEAST = 7
#: Lines of so many different words have them dealt to the parts, and in each part the least SPAN are taken.
MANY = 48
#: Lines of so many words have parts of pairs of neighbouring words.
PAIRED = 256
#: Differing bits of 128 within which a pair is verified; a pair at a similarity of 0.8 has about 36 (deviation 5).
RADIUS = 48
#: Lines under so many words are verified whatever their SimHashes.
FEW = 8
TILE = 512
#: Bytes of a word from which it is preferred.
LONG_WORD = 4
#: Characters of lines that are hashed at once: arrays that stay in a core's cache.
BATCH = 300_000

#: Pairs whose edit distances are taken at once, and the bits of the number that holds them.
AT_ONCE = 64
LANE_BITS = 40_000
#: Edits from which a pair is taken alone, within a band of its columns.
BANDED = 400
#: Pairs that a task puts off, to take the edit distances of those together that are needed.
PUT_OFF = 65_536
#: Pairs of rows whose SimHashes are compared at once.
PAIRS = 200_000

#: Pairs of parts that a task holds before it gives them out by range, and the fewest ranges.
HELD = 250_000
RANGES = 256

_OTHER = re.compile(r"[^\w\s]+")
_DIGITS = re.compile(r"\d")
_LATIN = bytes(ord(c.lower()) if c.isalnum() or c == "\n" else 32 for c in map(chr, range(256)))
_ZEROS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
#: Scripts written without blanks: their words are pairs of neighbouring characters.
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힣]+")
_TIMES = mix(np.arange(1, PARTS + 1, dtype=np.uint64)) | np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _zeros(line: str) -> str:
    folded = _DIGITS.sub("0", line)
    return line if 2 * folded.count("0") > len(line) else folded


def _plain(text: str) -> str:
    """A text in lower case with blanks for all but letters, digits and line ends."""
    try:  # a table of bytes is many times faster
        return text.encode("latin1").translate(_LATIN).decode("latin1")
    except UnicodeEncodeError:
        return _OTHER.sub(" ", text.lower().replace("_", " "))


def normalised_lines(text: str) -> list[str]:
    try:
        raw = text.encode("latin1")
    except UnicodeEncodeError:
        low = _plain(text)
        lines = [" ".join(x.split()) for x in low.split("\n")]
        return [_zeros(x) for x in lines] if _DIGITS.search(low) else lines
    low = raw.translate(_LATIN)
    while b"  " in low:
        low = low.replace(b"  ", b" ")
    low = low.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ")
    lines, zeros = low.decode("latin1").split("\n"), low.translate(_ZEROS)  # no other digits are in Latin-1
    if low == zeros:
        return lines
    return [x if 2 * z.count("0") > len(x) else z for x, z in zip(lines, zeros.decode("latin1").split("\n"), strict=True)]


def normalised(line: str) -> str:
    """A single line of a text."""
    out = " ".join(_plain(line).split())
    return _zeros(out) if _DIGITS.search(out) else out


def _spaced(line: str) -> str:
    return " ".join(_WIDE.sub(lambda m: f" {' '.join(m[0][i : i + 2] for i in range(max(1, len(m[0]) - 1)))} ", line).split())


def line_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of normalised lines, the words' bytes, and each line's first word and number of words."""
    joined = "\n".join(lines)
    data = joined.encode("utf-8", "surrogatepass")
    if (np.frombuffer(data, np.uint8) >= 0xE3).any() and _WIDE.search(joined):  # their first byte is no less
        lines = [*map(_spaced, lines)]
        data = "\n".join(lines).encode("utf-8", "surrogatepass")
    n = np.fromiter((x.count(" ") + 1 if x else 0 for x in lines), np.int64, len(lines))
    words, sizes = words_and_sizes(data)
    return words, sizes, np.cumsum(n) - n, n


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(*words.shape, 8), axis=-1, bitorder="little")


def _word(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")[..., 0]


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the one after it."""
    return mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]


def line_prints(lines: list[str]) -> np.ndarray:
    """The 128-bit SimHashes of lines over their distinct pairs of neighbouring words, as (lines, 2) words of 64 bits.

    Long lines of one language share most of their words, but few of their pairs.
    """
    words, _, start, n = line_words(lines)
    pairs = _pairs(words)
    of = np.repeat(np.arange(len(lines)), n)[: len(pairs)]
    inside = of == np.repeat(np.arange(len(lines)), n)[1:] if len(pairs) else np.zeros(0, bool)
    pairs, of = pairs[inside], of[inside]
    order = np.lexsort((pairs, of))
    pairs, of = pairs[order], of[order]
    new = np.r_[True, (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])] if len(pairs) else np.zeros(0, bool)
    pairs, of = pairs[new], of[new]
    out = np.zeros((len(lines), 2), np.uint64)
    n = np.bincount(of, minlength=len(lines))
    for half in range(2):
        hashes = mix(pairs + np.uint64(1 + half))
        ones = np.zeros((len(lines), 64), np.int32)
        for at in range(0, len(pairs), 1 << 14):
            here = of[at : at + (1 << 14)]
            edge = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            ones[here[edge]] += np.add.reduceat(_bits(hashes[at : at + (1 << 14)]), edge, axis=0, dtype=np.int32)
        out[:, half] = _word(2 * ones > n[:, None])
    return out


def _chosen(lines: np.ndarray, own: np.ndarray, out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of PARTS orders the least SPAN of each line's words (``own``, but those marked by ``out``)."""
    shift = np.uint64(32) + ((own & np.uint64(1)) << np.uint64(1))
    at = np.arange(own.shape[1], dtype=np.uint64)
    first = np.arange(len(own))[:, None] * own.shape[1]
    for times in _TIMES:
        order = ((own * times) >> shift << np.uint64(32)) | at
        order[out] = _FULL << np.uint64(32)
        order.partition(SPAN - 1, axis=1)
        pick = (order[:, :SPAN] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        yield lines, own.ravel()[pick + first]


def _dealt(lines: np.ndarray, own: np.ndarray, out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One order for all parts: words are dealt to PARTS classes, and the least SPAN of each class are its part."""
    order = (own >> np.uint64(1)) % np.uint64(PARTS) << np.uint64(61) | (~own & np.uint64(1)) << np.uint64(60) | own >> np.uint64(4)
    order[out] = _FULL
    order.sort(axis=1)
    row, flat, first = np.arange(len(order)) * order.shape[1], order.ravel(), np.zeros(len(order), np.int64)
    dealt = (order >> np.uint64(61)).astype(np.uint8)
    for j in range(PARTS):
        first += np.count_nonzero(dealt == j - 1, axis=1) if j else 0
        four = flat[row[:, None] + np.minimum(first[:, None] + np.arange(SPAN), order.shape[1] - 1)]
        whole = four[:, -1] >> np.uint64(61) == np.uint64(j)
        yield lines[whole], four[whole]


def _parts(wide: np.ndarray, start: np.ndarray, n: np.ndarray, marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, four of its features) for the parts of the lines ``wide``, whose lowest feature bit tells long words."""
    width = 1 << np.ceil(np.log2(np.maximum(n[wide], 1))).astype(np.int64)
    for w in np.unique(width).tolist():
        rows, step, col = wide[width == w], max(1, (1 << 16) // w), np.arange(w)
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            own = marked[np.minimum(start[r][:, None] + col, len(marked) - 1)]
            own[col >= n[r][:, None]] = _FULL
            own.sort(axis=1)
            out = own == _FULL
            out[:, 1:] |= own[:, 1:] == own[:, :-1]  # a word counts once
            different = w - np.count_nonzero(out, axis=1)
            few, many = different < MANY, different >= 3 * MANY // 4  # lines in between have both
            if few.any():
                yield from _chosen(r[few], own[few], out[few])
            if many.any():
                yield from _dealt(r[many], own[many], out[many])


def part_prints(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, SimHash) of the parts of lines: the pigeonhole blocks on which lines are joined."""
    words, sizes, start, n = line_words(lines)
    rows, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    hashes = mix(words + np.uint64(11))
    marked = words & ~np.uint64(1) | (sizes >= LONG_WORD).astype(np.uint64)
    # very long lines share most of a language's words: their parts are of pairs of words
    pairs = _pairs(words) | np.uint64(1)
    for line, four in chain(
        _parts(np.flatnonzero((n >= LEAST) & (n < PAIRED)), start, n, marked),
        _parts(np.flatnonzero(n >= 3 * PAIRED // 4), start, n - 1, pairs),
    ):
        a, b, c, d = mix(four).T
        rows.append(line)
        prints.append((a & b & (c | d)) | (c & d & (a | b)))  # the bits set in over half of four words
    short = np.flatnonzero((n <= SHORT) & (n >= 2))
    for k in range(0, len(short), 512):
        r = short[k : k + 512]
        at = np.minimum(start[r][:, None] + np.arange(SHORT), len(words) - 1)
        there = np.arange(SHORT) < n[r][:, None]
        bits = _bits(np.where(there, hashes[at], np.uint64(0))).view(np.int8)
        ones = bits.sum(1, dtype=np.int8)
        half = (n[r] // 2).astype(np.int8)[:, None]
        whole = _word(ones > half)
        # one less of ones and of words: over half of those left
        most = ones - ((n[r] - 1) // 2).astype(np.int8)[:, None]
        without = _word(most[:, None] > bits)
        size = np.where(there, sizes[at], 0)
        line, out = np.nonzero(there & (2 * size <= size.sum(1)[:, None]))  # half of the line must be left
        rows += [r, r[line]]
        prints += [whole, without[line, out]]
    return np.concatenate(rows), np.concatenate(prints)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns; any number over ``most`` where it is over ``most``."""
    if len(a) > len(b):
        a, b = b, a
    start, end = _common(a, b)  # what both have at either end doesn't count
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m = len(a)
    if not m:
        return len(b)
    limit = len(b) if most is None else most
    eq: dict[str, int] = {}
    for i, c in enumerate(a):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, d, left = full, 0, m, len(b)
    for c in b:
        x = eq.get(c, 0)
        h = (((x & up) + up) ^ up) | x | down
        more, less = down | ~(h | up) & full, h & up
        d += bool(more & top) - bool(less & top)
        left -= 1
        if d - left > limit:
            return d - left
        more = (more << 1 | 1) & full
        less = less << 1 & full
        up, down = less | ~((x | down) | more) & full, more & (x | down)
    return d


def all_within(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """For each pair whether its Levenshtein distance is at most ``most``: pairs of like lengths in the lanes of one number."""
    out = np.zeros(len(pairs), bool)
    rest: list[tuple[int, int, int, str, str]] = []
    for i, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        start, end = _common(a, b)
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        if len(b) <= most[i]:
            out[i] = True
        elif len(b) - len(a) <= most[i]:
            if BANDED <= most[i] < len(a):
                out[i] = _in_band(a, b, most[i])
            else:
                rest.append((len(a), len(b), i, a, b))
    rest.sort(key=lambda x: x[:3])
    while rest:
        count = max(1, min(AT_ONCE, LANE_BITS // (rest[-1][0] + 8)))
        part, rest = rest[-count:], rest[:-count]
        for (_, _, i, _, _), d in zip(part, _distances([x[3] for x in part], [x[4] for x in part]), strict=True):
            out[i] = d <= most[i]
    return out


def _in_band(a: str, b: str, most: int) -> bool:
    """Whether the distance of ``a`` to ``b``, which is no shorter, is at most ``most`` (under both lengths).

    Bit-parallel columns that hold only the rows within ``most`` of the diagonal and move down it by a row each (Hyyrö);
    ``d`` is the distance in the lowest of these rows, then in the last.
    """
    m, n = len(a), len(b)
    letters = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    eq = {c: int.from_bytes(np.packbits(letters == ord(c), bitorder="little").tobytes(), "little") << most for c in set(a)}
    full, last = (1 << 2 * most + 1) - 1, 1 << 2 * most
    up, down, d, limit = full >> most << most, 0, most, 2 * most + n - m
    for i, c in enumerate(b):
        x = eq.get(c, 0) >> i & full
        zero = ((x & up) + up ^ up | x | down) & full
        more, less = down | (zero | up) ^ full, zero & up
        if i < m - most:
            d += zero < last
            if d > limit:
                return False
        else:
            last >>= 1
            d += bool(more & last) - bool(less & last)
            if d - (n - 1 - i) > most:
                return False
        zero >>= 1
        up, down = less | (zero | more) ^ full, zero & more
    return d <= most


def _distances(short: list[str], long: list[str]) -> list[int]:
    """Levenshtein distances by bit-parallel columns, as in ``edit_distance``, of pairs side by side in one number.

    A lane has a bit more than its line has characters, into which the addition carries. A pair's distance is the sum
    of the differences down its last column.
    """
    size = max(map(len, short)) // 8 + 1
    nothing = bytes(size)
    ends: dict[int, list[int]] = {}
    columns, masks = [], []
    for k, (a, b) in enumerate(zip(short, long, strict=True)):
        eq: dict[str, int] = {}
        for i, c in enumerate(a):
            eq[c] = eq.get(c, 0) | 1 << i
        lane = {c: x.to_bytes(size, "little") for c, x in eq.items()}
        columns.append([lane.get(c, nothing) for c in b])
        masks.append(((1 << len(a)) - 1).to_bytes(size, "little"))
        ends.setdefault(len(b), []).append(k)
    full = int.from_bytes(b"".join(masks), "little")
    first = int.from_bytes((b"\1" + bytes(size - 1)) * len(short), "little") & full
    up, down, out = full, 0, [0] * len(short)
    for n, column in enumerate(zip_longest(*columns, fillvalue=nothing), 1):
        x = int.from_bytes(b"".join(column), "little")
        either = x | down
        h = (((x & up) + up) ^ up) | either
        more = ((down | (h | up) & full ^ full) << 1 | first) & full
        less = (h & up) << 1 & full
        up, down = less | (either | more) ^ full, more & either
        for k in ends.get(n, ()):
            at = slice(k * size, (k + 1) * size)
            plus, minus = (int.from_bytes(v.to_bytes(size * len(short), "little")[at], "little") for v in (up, down))
            out[k] = n + plus.bit_count() - minus.bit_count()
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks edges (a, b) that connect all that the edges do without a circle, in the order given."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out[k] = True
    return out


def bound(a: str, b: str) -> int:
    """No less than the edit distance: words of both in one order are kept, all between is replaced."""
    x, y = a.split(" "), b.split(" ")
    at = dict(zip(y, range(len(y)), strict=True))
    anchors = [(i, at[w]) for i, w in enumerate(x) if w in at]
    # the longest run of anchors that rises on both sides
    ends: list[int] = []
    tails: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(anchors):
        p = bisect_left(ends, j)
        before.append(tails[p - 1] if p else -1)
        if p == len(ends):
            ends.append(j)
            tails.append(k)
        else:
            ends[p] = j
            tails[p] = k
    cost, i, j = 0, len(x), len(y)
    k = tails[-1] if tails else -1
    while True:
        s, t = anchors[k] if k >= 0 else (-1, -1)
        if i - s > 1 or j - t > 1:
            u, v = x[s + 1 : i], y[t + 1 : j]
            while u and v and u[-1] == v[-1]:
                u.pop()
                v.pop()
            while u and v and u[0] == v[0]:
                u.pop(0)
                v.pop(0)
            if u or v:
                cost += max(sum(map(len, u)) + len(u), sum(map(len, v)) + len(v)) - (1 if u and v else 0)
        if k < 0:
            return cost
        i, j, k = s, t, before[k]


def _common(a: str, b: str) -> tuple[int, int]:
    """The characters that both have at the start, and at the end of the rest."""
    most = min(len(a), len(b))
    low, high = 0, most
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    start, low, high = low, 0, most - low
    while low < high:
        half = (low + high + 1) // 2
        if a[len(a) - half : len(a) - low] == b[len(b) - half : len(b) - low]:
            low = half
        else:
            high = half - 1
    return start, low


def _most(a: str, b: str, least: float) -> int:
    return int((1 - least) * max(len(a), len(b)) + 1e-9)


def surely(a: str, b: str, least: float) -> bool | None:
    """Whether two lines are similar, or None where only their edit distance can tell."""
    longest, most = max(len(a), len(b)), _most(a, b, least)
    if abs(len(a) - len(b)) > most:
        return False
    start, end = _common(a, b)
    if longest - start - end <= most:
        return True
    # what both have at either end is kept, but for the words that a cut would divide
    start, cut = a.rfind(" ", 0, start) + 1, a.find(" ", len(a) - end)
    end = len(a) - cut if cut >= 0 else 0
    return True if bound(a[start : len(a) - end], b[start : len(b) - end]) <= most else None


def _ranges(docs: DataFrame) -> int:
    """Key ranges for the pairs of ``docs``: one for each 8 MB that its files are said to have, as a power of two."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 16, max(RANGES, 1 << (size >> 23).bit_length()))


def _prints(docs: DataFrame, key: str, min_chars: int) -> DataFrame:
    """Two kinds of rows: (doc_id, key, line, h, check) of every line that takes part, where h and check are two hashes
    of its text; and (part, pairs), packed pairs of parts and h within one key range."""
    longs = [T.StructField(c, T.LongType()) for c in ("key", "line", "h", "check")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("range", T.IntegerType()), T.StructField("pairs", T.BinaryType())])
    ranges = _ranges(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for row, line, texts in pieces(b):
                h, check = np.frombuffer(b"".join([xxh3_128_digest(x) for x in texts]), np.uint64).reshape(-1, 2).T.copy()
                once = np.unique(h, return_index=True)[1]  # a repeated line gives its parts once
                of, prints = part_prints([texts[i] for i in once.tolist()])
                held.append(np.stack([prints, h[once[of]]], axis=1))
                size += len(of)
                at = pa.array(row, pa.int64())
                nothing = [pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())]
                longs = [pa.array(line, pa.int64()), pa.array(h.view(np.int64)), pa.array(check.view(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *longs, *nothing], names=[f.name for f in schema])
                if size > HELD:
                    yield packed(held, b)
                    held, size = [], 0
        if size:
            yield packed(held, b)

    def pieces(b: pa.RecordBatch) -> Iterator[tuple[list, list, list]]:
        row, line, texts, size = [], [], [], 0
        for i, t in enumerate(b.column(2)):
            for k, x in enumerate(normalised_lines(t.as_py() or "")):
                if len(x) >= min_chars:
                    row.append(i)
                    line.append(k)
                    texts.append(x)
                    size += len(x)
                    if size > BATCH:
                        yield row, line, texts
                        row, line, texts, size = [], [], [], 0
        if texts:
            yield row, line, texts

    def packed(held: list[np.ndarray], b: pa.RecordBatch) -> pa.RecordBatch:
        pairs = np.concatenate(held)
        place = mix(pairs[:, 0])  # one to one, and its first bits are the range
        order = np.lexsort((pairs[:, 1], place))
        pairs, of = pairs[order], (place[order] >> np.uint64(65 - ranges.bit_length())).astype(np.int64)
        new = np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]
        pairs, of = pairs[new], of[new]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        blobs = [x.tobytes() for x in np.split(pairs, edge[1:])]
        n = len(edge)
        return pa.RecordBatch.from_arrays([pa.nulls(n, b.column(0).type), *[pa.nulls(n, pa.int64())] * 4, pa.array(of[edge].astype(np.int32)), pa.array(blobs, pa.binary())], names=[f.name for f in schema])

    return map_texts(docs.select("doc_id", key, "text"), run, schema)


def _several(packed: DataFrame) -> DataFrame:
    """(k, id) of ``packed`` (range, pairs): the parts that several lines have, and those lines (some more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, many = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held += [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in b.column(0)]
                size += sum(map(len, held[-b.num_rows :])) if b.num_rows else 0
                if size < max(1_000_000, len(keys) // 4):
                    continue
            if not size:
                continue
            new = np.concatenate(held)
            held, size = [], 0
            k, h = np.concatenate([keys, new[:, 0]]), np.concatenate([firsts, new[:, 1]])
            known = len(keys)
            order = np.argsort(k, kind="stable")  # what is known comes first
            k, h = k[order], h[order]
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(k)]))
            first = h[edge]
            was = np.zeros(len(edge), bool)
            was[group[order < known]] = many
            other = (h != first[group]) & (order >= known)
            now = was.copy()
            now[group[other]] = True
            keys, firsts, many = k[edge], first, now
            fresh = now & ~was
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[fresh], k[other]]).view(np.int64)), pa.array(np.concatenate([first[fresh], h[other]]).view(np.int64))], names=["k", "id"])

    return map_texts(packed.repartition("range").select("pairs"), run, "k long, id long", 1000)


def _texts(docs: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(norm, few, p, q, tiles): the normalised lines at ``places`` (key, line, tiles), and their SimHashes in two halves."""
    wanted = places.groupBy("key").agg(F.collect_list(F.struct("line", "tiles")).alias("at"))
    joined = docs.select(F.col(key).alias("key"), "text").join(wanted.hint("shuffle_hash"), "key").select("key", "text", "at.line", "at.tiles")
    schema = T.StructType([*T._parse_datatype_string("norm string, few boolean, p long, q long").fields, places.schema["tiles"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat both doc_id and text are one document
        for b in batches:
            tiles = b.column(3).flatten()
            first = np.r_[0, np.cumsum(b.column(2).value_lengths().to_numpy())]
            at, norm, size = [], [], 0
            for row, (this, text, of) in enumerate(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)):
                if this in seen:
                    continue
                seen.add(this)
                lines = text.split("\n")
                for i, k in enumerate(of, int(first[row])):
                    if k < len(lines):
                        at.append(i)
                        norm.append(normalised(lines[k]))
                        size += len(norm[-1])
                if size > BATCH:
                    yield out(norm, tiles, at)
                    at, norm, size = [], [], 0
            if at:
                yield out(norm, tiles, at)

    def out(norm: list, tiles: pa.Array, at: list) -> pa.RecordBatch:
        prints = line_prints(norm).view(np.int64)
        few = pa.array([x.count(" ") + 1 < FEW for x in norm])
        return pa.RecordBatch.from_arrays([pa.array(norm, pa.string()), few, pa.array(prints[:, 0]), pa.array(prints[:, 1]), tiles.take(pa.array(at, pa.int64()))], names=["norm", "few", "p", "q", "tiles"])

    return map_texts(joined, run, schema, 200)


def _tiles(blocks: DataFrame, tile: int) -> DataFrame:
    """(id, tiles): for each line of ``blocks`` (k, id) its blocks' tiles, with all of its blocks."""
    rows = tiled(blocks, ["k"], tile).select("id", F.struct(F.xxhash64("k", "_tile").alias("g"), "_right", "k").alias("t"))
    return rows.groupBy("id").agg(F.collect_list("t").alias("of")).select("id", F.struct("id", F.array_distinct("of.k").alias("ks"), "of").alias("tiles"))


def _verified(lines: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect exactly the lines (norm, ..., tiles) of a block with a chain of verified pairs.

    A pair of several blocks is verified in the least of them.
    """
    rows = lines.select("tiles.id", "norm", "few", "p", "q", "tiles.ks", F.explode("tiles.of").alias("t"))
    dealt = rows.select("id", "t.g", "t._right", "norm", "few", "p", "q", "t.k", "ks").repartition("g").sortWithinPartitions("g", "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, right, norm, few, p, q, key, ks in whole_groups(batches, 20_000):
            p, q = p.view(np.uint64), q.view(np.uint64)
            size = np.fromiter(map(len, norm), np.int64, len(norm))
            n, most = np.fromiter(map(len, ks), np.int64, len(ks)), np.iinfo(np.int64).max
            own = np.concatenate(ks)
            # each line's blocks, the first repeated to fill up
            own = own[(np.cumsum(n) - n)[:, None] + np.where(np.arange(n.max()) < n[:, None], np.arange(n.max()), 0)]
            names, node = np.unique(ids, return_inverse=True)  # a line may be in several groups
            root, of = list(range(len(names))), node.tolist()
            doubt: list[tuple[int, int]] = []

            def find(x: int) -> int:
                while (up := root[x]) != x:
                    root[x] = x = root[up]
                return x

            def apart(i, j):
                return np.bitwise_count(p[i] ^ p[j]).astype(np.int64) + np.bitwise_count(q[i] ^ q[j])

            def may_be(i, j):
                """Those of the pairs (i, j) of one group that are to be verified there."""
                near = (apart(i, j) <= RADIUS) | few[i] | few[j]
                near &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
                i, j = i[near], j[near]
                step, least = max(1, (1 << 22) // own.shape[1] ** 2), np.zeros(len(i), bool)
                for k in range(0, len(i), step):
                    a, b = own[i[k : k + step]], own[j[k : k + step]]
                    both = (a[:, :, None] == b[:, None, :]).any(-1)
                    least[k : k + step] = np.where(both, a, most).min(1) == key[i[k : k + step]]
                return i[least], j[least]

            def settle():
                """The pairs put off, by edit distance: first those that could connect what is apart, the likeliest of
                them first, and the others only where these turned out not to."""
                whole = Forest(len(names))
                whole.root = np.array([find(x) for x in range(len(names))])
                i, j = np.array(doubt, np.int64).reshape(-1, 2).T
                order = np.argsort(apart(i, j), kind="stable")
                i, j = i[order], j[order]
                while len(i):
                    now = spanning(whole.root[node[i]], whole.root[node[j]])
                    pairs = [(norm[x], norm[y]) for x, y in zip(i[now].tolist(), j[now].tolist(), strict=True)]
                    yes = all_within(pairs, [_most(a, b, similarity) for a, b in pairs])
                    whole.join(node[i[now][yes]], node[j[now][yes]])
                    left = ~now & (whole.root[node[i]] != whole.root[node[j]])
                    i, j = i[left], j[left]
                doubt.clear()
                root[:] = whole.root.tolist()

            # a row's pairs are with the rows before it in its group, or with the left ones where there are both sides
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            high = np.r_[edge[1:], len(g)]
            cut = edge + np.add.reduceat((~right).astype(np.int64), edge)
            group, row = np.repeat(np.arange(len(edge)), high - edge), np.arange(len(g))
            two = ((edge < cut) & (cut < high))[group]
            count = np.where(two, np.where(right, cut[group], edge[group]), row) - edge[group]
            ends = np.cumsum(count)
            low = 0
            while low < len(g):
                top = max(low + 1, int(np.searchsorted(ends, ends[low] - count[low] + PAIRS, side="right")))
                many = count[low:top]
                i = np.repeat(row[low:top], many)
                i, j = may_be(i, edge[group[i]] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many))
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    u, v = find(of[x]), find(of[y])
                    if u != v:
                        sure = surely(norm[x], norm[y], similarity)
                        if sure:
                            root[max(u, v)] = min(u, v)
                        elif sure is None:
                            doubt.append((x, y))
                if len(doubt) >= PUT_OFF:
                    settle()
                low = top
            settle()
            roots = np.array(root)
            at = np.flatnonzero(roots != np.arange(len(names)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[roots[at]])], names=["a", "b"])

    return map_texts(dealt, run, "a long, b long", 500)


def shared_blocks(packed: DataFrame) -> DataFrame:
    """(k, id): the parts that several lines have, and those lines; of parts with the same lines only one."""
    blocks = kept(_several(packed).distinct(), "line-blocks")
    alike = blocks.groupBy("k").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
    one = kept(alike.groupBy("least", "most", "n", "x").agg(F.min("k").alias("k")).select("k"), "line-one")
    return kept(blocks.join(one, "k"), "line-blocks")


def removed_lines(docs: DataFrame, key: str, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, tile: int = TILE) -> DataFrame:
    """(doc_id, key, lines): the numbers of the lines that go, for each text of ``docs`` (with its ``key``) that loses any."""
    rows = kept(_prints(docs, key, min_chars), "line-prints")
    prints = rows.where("range is null").select("doc_id", "key", "line", "h", "check")
    blocks = shared_blocks(rows.where("range is not null").select("range", "pairs"))
    # a line that no other equals or shares a part with has nothing to remove
    often = prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    asked = kept(often.union(blocks.select(F.col("id").alias("h"))).distinct(), "line-asked")
    prints = kept(prints.join(asked.hint("shuffle_hash"), "h"), "line-places")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("key"), F.col("line").alias("line"), F.col("check").alias("check"))
    nodes = kept(prints.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-nodes")
    tiles = kept(_tiles(blocks, tile), "line-tiles").withColumnRenamed("id", "h")
    places = nodes.join(tiles, "h").select(F.col("first.key").alias("key"), F.col("first.line").alias("line"), "tiles")
    edges = _verified(_texts(docs, key, places), similarity)
    same = components(edges, "line-groups").select(F.col("node").alias("h"), F.col("root").alias("g"))
    nodes = nodes.join(same, "h", "left").withColumn("g", F.coalesce("g", "h"))
    # of each group the first place stays; a node alone with one occurrence has nothing to remove
    first = kept(nodes.groupBy("g").agg(F.min("first").alias("stays"), F.sum("n").alias("all")).where("all > 1"), "line-first")
    losers = kept(nodes.join(first, "g").select("h", F.col("first.check").alias("own"), "stays.key", "stays.line").select("h", "own", F.col("key").alias("stay_key"), F.col("line").alias("stay_line")), "line-losers")
    # lines of one hash are equal when their second hash is, too
    gone = prints.join(losers, "h").where(((F.col("key") != F.col("stay_key")) | (F.col("line") != F.col("stay_line"))) & (F.col("check") == F.col("own")))
    return kept(gone.groupBy("doc_id", "key").agg(F.collect_set("line").alias("lines")), "line-gone")


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, tile: int = TILE, counts: bool = False) -> DataFrame:
    """``docs`` with one occurrence of every group of fuzzy-equal lines left; with ``counts``, n_lines and n_removed too."""
    key, lines, of = (free_name(docs, x) for x in ("key", "lines", "of"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    gone = removed_lines(keyed, key, similarity, min_chars, tile).select(F.col("doc_id").alias(of), F.col("key").alias(key), F.col("lines").alias(lines))
    joined = keyed.join(gone.hint("shuffle_hash"), (keyed[key] == gone[key]) & keyed["doc_id"].eqNullSafe(gone[of]), "left").drop(gone[key]).drop(key, of)
    parts = F.split("text", "\n")
    numbers = F.coalesce(F.col(lines), F.array().cast("array<bigint>"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1), numbers)
    # ``p`` is the text cut into lines once, not for each line that is left
    rest = F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.get(p, i.cast("int"))), "\n"))
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.get(rest, F.lit(0)))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    extra = {"n_lines": n_lines, "n_removed": F.size(numbers)} if counts else {}
    return joined.withColumns(extra | {"text": text}).drop(lines)
