"""Near-dedup by SimHash of word shingles of five, for links of a similarity of 0.8; exact Jaccard similarity decides.

This is operator 3's method (``simhash``: SimHashes, blocks as keys, bit planes compared 64 at a time, tiles that give
spanning forests) for a much wider radius. A text's words give shingles of five; a text with fewer is one shingle.
Texts with equal shingle sets are one node. At a Jaccard similarity of 0.8 some 10 of 64 bits differ, so the blocks of
64 bits that a radius of 3 leaves equal are no keys here. A node has a SimHash of several words, cut into blocks of
``b`` bits, which are its keys: ``b`` grows with the logarithm of the number of texts, so that a key has about ``CROWD``
unrelated texts, and there are as many blocks as let a pair of similarity 0.8 share none with probability ``MISS``.
Within a key the first ``PRINT`` words are compared bit-sliced within ``RADIUS`` bits. Nodes linked so are brought
together with their shingles, in tiles of bounded size, and pairs within the radius are verified unless they are
connected already. Chains of verified pairs are one group.

Defined results: null and wordless texts have the empty set and are equal; a null doc_id is kept only where all of a
group are null; a row that is there twice with its doc_id and text stays once; empty tables give empty results; all
columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, map_texts
from .bitslice import Forest, links
from .components import components
from .hashing import mix
from .simhash import SEED, one_of_each, tiled, whole_groups

SHINGLE = 5
SIMILARITY = 0.8
#: The probability that a pair of SIMILARITY shares no key, and the share of equal bits of such a pair.
MISS = 0.0001
AGREE = 0.848
#: A key's expected number of unrelated texts, above which longer keys are used, and the bounds of a key's bits.
CROWD = 128
LEAST_BITS, MOST_BITS = 8, 24
#: Words of 64 bits that are compared, and their differing bits: about 19 (deviation 4) at SIMILARITY, 64 (6) if unrelated.
PRINT = 2
RADIUS = 38
#: Nodes in one side of a tile: of texts to be verified, and of SimHashes to be compared.
TILE = 512
PRINT_TILE = 8192
#: Shingles whose bits are summed at once, in bytes.
PART = 255


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    first, last = [0, *(ends[: n - 1] + 1).tolist()], ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64))


def blocks_for(n: int) -> tuple[int, int]:
    """The bits of a key, and the number of keys, for ``n`` texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / CROWD))))
    return bits, math.ceil(math.log(MISS) / math.log(1 - AGREE**bits))


def simhash(own: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of shingle hashes, of ``words`` words of 64 bits: the bits set in over half."""
    salt = mix(np.arange(1, words + 1, dtype=np.uint64))
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), PART):
        bits = np.unpackbits(mix(own[at : at + PART, None] + salt).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view("<u8").astype(np.uint64)


def words_for(bits: int, tables: int) -> int:
    return max(PRINT, -(-bits * tables // 64))


def keys_of(prints: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The keys of SimHashes (n, words): the number of a block, and its bits; (n, tables)."""
    flat = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    blocks = flat[:, : bits * tables].reshape(len(prints), tables, bits)
    value = np.zeros(blocks.shape[:2], np.int64)
    for i in range(bits):
        value |= blocks[:, :, i].astype(np.int64) << i
    return value | np.arange(tables, dtype=np.int64) << 32


def band_keys(own: np.ndarray, n: int = 1_000_000) -> np.ndarray:
    """The keys of a set of shingle hashes, one of ``n`` texts."""
    bits, tables = blocks_for(n)
    return keys_of(simhash(own, words_for(bits, tables))[None], bits, tables)[0]


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, s, sim): the hash of each text's shingle set, and its SimHash."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("s", T.LongType()), T.StructField("sim", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            whole = np.array([np.add.reduce(mix(x)) + np.uint64(len(x)) for x in own], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole.view(np.int64)), pa.array([simhash(x, words).tobytes() for x in own], pa.binary())], names=["doc_id", "s", "sim"])

    return map_texts(docs.select("doc_id", "text"), run, schema)


def _keyed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, p, q, key) for each key of each node; p and q are the words that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            cols = [np.repeat(x, tables) for x in (b.column(0).to_numpy(), *prints[:, :PRINT].T.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(keys_of(prints, bits, tables).ravel())], names=["id", "p", "q", "key"])

    return map_texts(nodes.select("s", "sim"), run, "id long, p long, q long, key long")


def near_links(keyed: DataFrame, tile: int = PRINT_TILE) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes of ``keyed`` (id, p, q, key) of one key within the radius."""
    rows = tiled(keyed, ["key"], tile).select("id", F.xxhash64("key", "_tile").alias("g"), "_right", "p", "q")
    dealt = rows.repartition("g").sortWithinPartitions("g", "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, right, p, q in whole_groups(batches):
            root = links(np.stack([p, q], axis=1).view(np.uint64), g, right, RADIUS).root
            at = np.flatnonzero(root != np.arange(len(ids)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])

    return map_texts(dealt, run, "a long, b long", 10_000)


def _sets(docs: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """(id, root, sim, own): the shingles of the texts at ``places`` (_key, id, root, sim)."""
    joined = docs.select("_key", "text").join(places, "_key").select("id", "root", "sim", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([shingles(t, shingle).tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), own], names=["id", "root", "sim", "own"])

    return map_texts(joined, run, "id long, root long, sim binary, own binary", 200)


def _verified(sets: DataFrame, least: float, tile: int) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes with a chain of verified pairs."""
    rows = tiled(sets, ["root"], tile).select("id", F.xxhash64("root", "_tile").alias("g"), "_right", "sim", "own")
    dealt = rows.repartition("g").sortWithinPartitions("g", "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, g, right, sim, own in whole_groups(batches, 500):
            sim = np.frombuffer(b"".join(sim), np.uint64).reshape(len(ids), -1)
            own = [np.frombuffer(x, np.uint64) for x in own]
            forest = Forest(len(ids))
            edge = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist(), len(g)]
            for low, high in zip(edge, edge[1:], strict=False):
                cut = low + int(np.count_nonzero(~right[low:high]))
                two = low < cut < high
                for i in range(cut if two else low + 1, high):
                    other = np.arange(low, cut if two else i)
                    other = other[np.bitwise_count(sim[other] ^ sim[i]).sum(axis=1, dtype=np.int64) <= RADIUS]
                    while len(other := other[forest.root[other] != forest.root[i]]):
                        j, other = int(other[0]), other[1:]
                        if alike(own[i], own[j], least):
                            forest.root[forest.root == max(forest.root[i], forest.root[j])] = min(forest.root[i], forest.root[j])
            at = np.flatnonzero(forest.root != np.arange(len(ids)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[forest.root[at]])], names=["a", "b"])

    return map_texts(dealt, run, "a long, b long", 200)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, print_tile: int = PRINT_TILE) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id (null last); all columns kept."""
    key = F.xxhash64("doc_id", "text")
    bits, tables = blocks_for(docs.count())
    prints = kept(_prints(docs.select(F.struct("doc_id", key.alias("k")).alias("doc_id"), "text"), shingle, words_for(bits, tables)), "shingle-prints")
    order = F.struct(F.col("doc_id.doc_id").isNull().alias("a"), F.col("doc_id.doc_id").alias("b"), F.col("doc_id.k").alias("k"))
    nodes = kept(prints.groupBy("s").agg(F.min(order).alias("first"), F.min("sim").alias("sim")), "shingle-nodes")
    keyed = kept(_keyed(nodes, bits, tables), "shingle-keys")
    shared = components(near_links(keyed, print_tile), "shingle-shared").select(F.col("node").alias("s"), "root")
    places = nodes.join(shared, "s").select(F.col("first.k").alias("_key"), F.col("s").alias("id"), "root", F.substring("sim", 1, 8 * PRINT).alias("sim"))
    sets = kept(_sets(docs.select(key.alias("_key"), "text"), places, shingle), "shingle-sets")
    roots = components(_verified(sets, similarity, tile), "shingle-groups").select(F.col("node").alias("s"), "root")
    return one_of_each(docs, key, prints, nodes, roots, "s")
