import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plainsense.llm import suffix_dedup as sd


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(20, 900)))
    passages = [word() for _ in range(6)]
    texts = ["".join(rnd.choice([rnd.choice(passages), word()]) for _ in range(rnd.randint(1, 5))) for _ in range(30)]
    for t in texts[:8]:  # near copies: one character changed
        i = rnd.randrange(len(t))
        texts.append(t[:i] + "#" + t[i + 1 :])
    return texts + [texts[3], "a" * 1500, "ab" * 400, "a" * 199, "b" * 200, "", None, "xy" * 99]


@pytest.mark.parametrize(("seed", "length", "first", "group"), [(1, 200, 50, 2000), (2, 200, 50, 3), (3, 40, 10, 2000), (4, 40, 16, 2)])
def test_against_brute_force(spark, seed, length, first, group):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n long")
    got = sd.suffix_dedup(docs, length, first, group).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute([(t or "").encode() for t in texts], length)


def test_repeated_rows_and_null_ids(spark):
    rnd = random.Random(5)
    a, b = ("".join(rnd.choice("abcdef ") for _ in range(600)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (1, a), (None, b), (2, b[:300])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.suffix_dedup(docs).collect())
    assert got == [(0, 600, 300), (1, 600, 600), (1, 600, 600), (2, 300, 300)]


def test_segments_sample_the_same_positions():
    data = np.frombuffer(random.Random(1).randbytes(20_000), np.uint8) % 7
    whole = sd.sample(data)
    parts = [np.concatenate(x) for x in zip(*sd.sampled(data, segment=3000), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_empty_table_and_text(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    rows = sd.suffix_dedup(spark.createDataFrame([(1, "x" + t), (2, "yy" + t + "z")], "doc_id long, text string"), with_text=True).collect()
    assert sorted(bytes(r.kept_bytes) for r in rows) == [b"x", b"yyz"]
