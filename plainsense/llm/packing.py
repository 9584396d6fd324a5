"""Best-fit packing: tokenize, cut what is longer than a sequence, and pack the pieces by bulk-synchronous best fit.

The documents are ranked within their lengths by Spark (a sort of narrow rows, dealt by length and a salt, so that a
length that a third of all rows share is ranked by many tasks). Lengths are whole numbers up to the sequence size, so
the range-sorted documents are runs (length, count) and the sorted gaps are runs (gap, sequences from, to): at most
``size`` of the first and, because gaps of one value are kept together, a few times ``size`` of the second. One round
per length, longest first, sweeps over the gap runs for the successors of that length (the smallest gap that holds
it), gives every member its place by rank, so that no two documents want one place, opens sequences for the rest, and
updates the gaps. This is exactly best-fit decreasing. The rounds run over the runs alone (their number doesn't grow
with the corpus) and their outcome is joined to the ranked documents in Spark.

Defined results: a null text is the empty text, whose only token is the end token; repeated rows are packed each on
their own (the order of equal rows is arbitrary, and they are equal); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._shared import kept

SIZE = 2048
END_ID = 0
#: Words whose ids a worker keeps: about 150 bytes each.
CACHE_WORDS = 600_000
SALTS = 64
#: Rows of the plan, or of the salts' bases, that are broadcast: 48 bytes each. Lengths times salts are 131,072 at most.
BROADCAST_ROWS = 500_000

# fixed values: what the tokenizer's file must say for its words to be looked up one by one
_KNOWN = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "patterns": ["\\s+", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"],
}

# fixed values: the tokenizer's own split pattern, and the byte alphabet of byte-level vocabularies
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Texts made of these alone split the same way under any Unicode version; others go to the tokenizer whole.
_PLAIN = re.compile(r"[\t-\r -~¡-¬®-±´-¸»¿-ʯ‐-‧€]*\Z")
_DIGITS = re.compile(r"[²³¹¼-¾]")


def _steps(config: dict) -> dict:
    """The kinds of a tokenizer file's steps, and the patterns that they use."""
    first = (config.get("normalizer") or {}).get("normalizers") or []
    then = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
    patterns = [(x.get("pattern") or {}).get("Regex") for x in (*first, *then) if "pattern" in x]
    return {"normalizer": [x["type"] for x in first], "pre_tokenizer": [x["type"] for x in then], "patterns": patterns}


class FastTokenizer:
    """The ids of a ``tokenizers`` file as little-endian 32-bit bytes.

    Where a text holds only plain characters, its words are looked up in a bounded table and only new ones go through
    the vocabulary's merges; any other text is encoded whole, and so is every text with a file that normalises or splits
    in another way. Both ways give the tokenizer's ids.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, cache_words
        self.known = _steps(json.loads(self.tokenizer.to_str())) == _KNOWN
        spare = iter(range(256, 512))
        self.bytes = {b: chr(b) if b in set(_PRINTED) else chr(next(spare)) for b in range(256)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            found = self.model.tokenize(piece.encode().decode("latin1").translate(self.bytes))
            ids = b"".join(t.id.to_bytes(4, "little") for t in found)
            if len(piece) < 40:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = b"".join(map(self._piece, _SPLIT.findall(word.lower())))
        if len(word) < 40:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.known or "<|" in text or not _PLAIN.match(text) or not unicodedata.is_normalized("NFC", text) or _DIGITS.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        words, known = text.split(), self.words
        ids = [*map(known.get, words)]
        if None in ids:
            ids = [i if i is not None else self._word(w) for i, w in zip(ids, words, strict=True)]
        return b"".join(ids)


_tokenizers: dict[str, FastTokenizer] = {}


def tokenizer(path: str) -> FastTokenizer:
    """The worker's tokenizer for this file: workers live longer than tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = FastTokenizer(path)
    return _tokenizers[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with ``ids`` the ids as bytes (token_ids)."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                tokens = encode(text or "") + end
                for k, at in enumerate(range(0, len(tokens), 4 * size)):
                    part = tokens[at : at + 4 * size]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if ids else [])))
            yield pd.DataFrame(out, columns=[f.name for f in schema]).astype({"doc_id": batch.doc_id.dtype})

    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *([T.StructField("token_ids", T.BinaryType())] if ids else [])])
    # a nullable integer key would reach pandas as a float: it travels as text
    ship(docs.sparkSession)
    sent = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text_schema = T.StructType([T.StructField("doc_id", T.StringType()), *schema.fields[1:]])
    return sent.mapInPandas(cut, text_schema).withColumn("doc_id", F.col("doc_id").cast(key)).select(*[f.name for f in schema])


def best_fit_runs(lengths: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over runs: (length, rank from, rank to, first sequence, members a sequence, offset).

    Members [from, to) of a length go to sequences from ``first sequence`` on, so many to each, side by side from
    ``offset``. A run of gaps is (first sequence, sequences); runs of one gap value wait in one heap.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    values: list[int] = []  # the gap values that have runs, kept sorted
    plan, opened = [], 0

    import bisect

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(values, gap)
        heapq.heappush(gaps[gap], (first, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            at = bisect.bisect_left(values, length)  # the successor sweep: the smallest gap that holds it
            if at == len(values):
                each = size // length
                n, some = divmod(left, each)
                if n:
                    plan.append((length, rank, rank + n * each, opened, each, 0))
                    put(size - each * length, opened, n)
                if some:
                    plan.append((length, rank + n * each, rank + left, opened + n, some, 0))
                    put(size - some * length, opened + n, 1)
                opened += n + (some > 0)
                break
            gap = values[at]
            each, runs = gap // length, gaps[gap]
            first, n = heapq.heappop(runs)
            if not runs:
                del gaps[gap]
                values.pop(at)
            full, some = min(n, left // each), 0
            if full < n:
                some = left - full * each
            if full:
                plan.append((length, rank, rank + full * each, first, each, size - gap))
                put(gap - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < n:
                if some:
                    plan.append((length, rank, rank + some, first + full, some, size - gap))
                    put(gap - some * length, first + full, 1)
                    rank, left = rank + some, 0
                put(gap, first + full + (some > 0), n - full - (some > 0))
    return plan


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS rows, joined beyond."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def pack(pieces: DataFrame, size: int = SIZE, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``size``."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "token_ids"]), F.lit(salts)).cast("int"))
    salted = kept(salted, "packing-pieces")
    counts = [tuple(r) for r in salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most size x salts rows
    total: dict[int, int] = {}
    bases = []
    for length, salt, n in sorted(counts):
        bases.append((length, salt, total.get(length, 0)))
        total[length] = total.get(length, 0) + n
    plan = best_fit_runs(total, size)
    base = spark.createDataFrame(bases, "length long, _salt int, _base long")
    from pyspark.sql import Window

    order = Window.partitionBy("length", "_salt").orderBy(*[c for c in pieces.columns if c not in ("token_ids", "length")])
    ranked = salted.withColumn("_row", F.row_number().over(order) - 1).join(_small(base, len(bases)), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_base"))
    # a hash join on the length, which tries each run of it: the plan and the bases are checked tables of a few MB
    runs = spark.createDataFrame(plan, "length long, _from long, _to long, _first long, _each long, _at long")
    ranked = ranked.join(_small(runs, len(plan)), (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(runs["length"])
    inside = F.col("_rank") - F.col("_from")
    return ranked.select(*pieces.columns, (F.col("_first") + F.floor(inside / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_at") + F.pmod(inside, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs ``docs`` (doc_id, text)."""
    return pack(tokenized_pieces(docs, tokenizer_path, size, end_id, ids), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, for a result with token_ids: sequence_id, n_tokens, token_ids (bytes)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["token_ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("token_ids"))


def default_tokenizer() -> str:
    """The public word-level vocabulary; any other file of the same library can be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's form: production parameters over a whole table."""
    return pack_documents(docs, default_tokenizer())
