import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from plainsense.llm import packing as pk


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(pk.default_tokenizer())


ODD = ["", "it's THE '70s  can't we'LL", "ÀÉß ñandú naïve ﬁ", "日本語 text", "<|endoftext|> a", "é café", "a_b__c 1234 ½ x²", " x\x1cy", "ΣΑΣ σας", "!!!...??", "İstanbul K", "\tx\r\ny\x0bz", "word" * 500, "don't'sx", "🙂 ok", "a-b/c", "ªº"]


def test_ids_equal_the_tokenizers(tok):
    rnd = random.Random(1)
    fast = pk.FastTokenizer(pk.default_tokenizer(), cache_words=50)
    chars = "abcdefgXYZ  '_.,!0189éñßüÀ-—’“\n\t"
    texts = ODD + ["".join(rnd.choice(chars) for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert fast.encode(t) == struct.pack(f"<{len(want)}I", *want), t


def check(rows, got, tok, size):
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want.append((i, k // size, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [2048, 37])
def test_documents(spark, tok, size):
    rnd = random.Random(2)
    rows = [(i, " ".join("ab" for _ in range(rnd.choice([1, 5, 20, 300, 5000])))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (7, None), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, piece string, length int")
    got = pk.pack_documents(docs, pk.default_tokenizer(), size, ids=True)
    n = check(rows, got.collect(), tok, size)
    total = sum(r.length for r in got.collect())
    assert n <= -(-total // size) * 11 / 9 + 1
    seqs = pk.sequences(got).collect()
    assert sum(r.n_tokens for r in seqs) == total and all(len(r.token_ids) == 4 * r.n_tokens for r in seqs)


def test_empty_table(spark):
    assert pk.pack_documents(spark.createDataFrame([], "doc_id long, text string"), pk.default_tokenizer()).count() == 0


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


def test_runs_are_best_fit_decreasing():
    rnd = random.Random(4)
    for _ in range(200):
        size = rnd.randint(5, 60)
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 120))]
        counts = {n: lengths.count(n) for n in lengths}
        plan = pk.best_fit_runs(counts, size)
        places = {}
        for n, a, b, first, each, at in plan:
            for r in range(a, b):
                places.setdefault(first + (r - a) // each, []).append((at + (r - a) % each * n, n))
        assert sum(map(len, places.values())) == len(lengths)
        for parts in places.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= size
        assert len(places) == best_fit_decreasing(lengths, size)


def test_other_tokenizer_files_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, fast = Tokenizer.from_file(path), pk.FastTokenizer(path)
    for t in [*ODD, "Plain text, with Capitals and 123 numbers."]:
        want = other.encode(t, add_special_tokens=False).ids
        assert fast.encode(t) == struct.pack(f"<{len(want)}I", *want), t
    assert pk.FastTokenizer(pk.default_tokenizer()).known
