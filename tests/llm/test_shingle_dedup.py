import random

import corpus_pipeline
import numpy as np

from plainsense.llm import shingle_dedup as sd


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def changed(words, rnd, n):
    out = list(words)
    for k in range(n):
        out[(2 * k + 1) * len(out) // (2 * n)] = f"new{rnd.random()}"
    return out


def brute_kept(rows):
    """The doc_ids that stay by comparing all pairs of shingle sets."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union - 1e-9:
                p, q = root[a], root[b]
                root = [min(p, q) if r == max(p, q) else r for r in root]
    return [i for k, (i, _) in enumerate(rows) if root[k] == k]


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for n in (1, 3, 5, 40, 90, 200, 200, 200, 400, 400, 1500):
        base = [word() for _ in range(n)]
        rows.append(" ".join(base))
        for k in (1, 2, 3, 4, 5, 6, 8):
            rows.append(" ".join(changed(base, rnd, k)) if n >= 90 else " ".join([*base, word()]))
        rows.append(" ".join(base).upper())
    rows += [None, "", " \n ", "x " * 3000]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies_stage_against_all_pairs(spark):
    """The stage of the pipeline links by five-word similarity of 0.8, where three-word SimHash within 3 bits doesn't."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies_go(spark, docs, "").collect())
    assert got == brute_kept(rows)


def test_tiles_and_repeated_rows(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = [(i, " ".join(changed(base, rnd, 2))) for i in range(40)]
    rows += [(99, "only once here in this table"), (99, "only once here in this table"), (None, rows[3][1])]
    got = sd.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tile=7).collect()
    assert sorted(r.doc_id for r in got) == [0, 99]


def test_recall_at_the_similarity_itself():
    """Sets of similarity 0.8 share a band key but for one pair in ten thousand."""
    rnd = np.random.default_rng(6)
    missed = 0
    for _ in range(2000):
        x = rnd.integers(0, 1 << 64, 90, np.uint64)
        a, b = x[:81], x[9:]  # 72 of 90 in common
        missed += not (sd.band_keys(a) == sd.band_keys(b)).any()
    assert missed <= 3


def test_simhash_bits():
    rnd = np.random.default_rng(7)
    for n in (0, 1, 2, 9, 254, 255, 256, 700):
        own = rnd.integers(0, 1 << 64, n, np.uint64)
        got = sd.simhash(own, 3)
        for word in range(3):
            h = sd.mix(own + sd.mix(np.array([word + 1], np.uint64)))
            ones = [int(np.count_nonzero(h >> np.uint64(i) & np.uint64(1))) for i in range(64)]
            assert int(got[word]) == sum(1 << i for i in range(64) if 2 * ones[i] > n)


def test_simhashes_decide_what_is_linked(spark):
    """Edges connect exactly the SimHashes of a common block within the radius, whatever the tiles; all at 0.8 are within it."""
    rnd = np.random.default_rng(8)
    bits, tables = sd.blocks_for(1000)
    sets, like = [], []
    for k in range(30):
        x = rnd.integers(0, 1 << 64, 99, np.uint64)
        sets += [x[:81], x[9:90], x[18:99]]  # 72 of 90 in common, then 63 of 99
        like += [(3 * k, 3 * k + 1), (3 * k + 1, 3 * k + 2)]
    prints = np.stack([sd.simhash(np.sort(x), sd.words_for(bits, tables)) for x in sets])
    keys = sd.keys_of(prints, bits, tables)
    near = lambda a, b: (keys[a] == keys[b]).any() and np.bitwise_count(prints[a, : sd.PRINT] ^ prints[b, : sd.PRINT]).sum() <= sd.RADIUS
    assert all(near(a, b) for a, b in like)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if near(a, b):
                p, q = root[a], root[b]
                root = [min(p, q) if r == max(p, q) else r for r in root]
    rows = [(i, *prints[i, : sd.PRINT].view(np.int64).tolist(), int(k)) for i in range(len(sets)) for k in keys[i]]
    keyed = spark.createDataFrame(rows, "id long, p long, q long, key long")
    for tile in (sd.PRINT_TILE, 2):
        got = {r.node: r.root for r in sd.components(sd.near_links(keyed, tile)).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == root


def test_keys_grow_with_the_texts():
    """A key holds a bounded number of unrelated texts, and a pair of similarity 0.8 misses all keys as rarely at any size."""
    for n in (0, 1, 1000, 10**6, 10**8, 10**9):
        bits, tables = sd.blocks_for(n)
        assert n <= sd.CROWD << bits and (1 - sd.AGREE**bits) ** tables <= sd.MISS
