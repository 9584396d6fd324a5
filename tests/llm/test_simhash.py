import random
import re

import numpy as np
import xxhash

from plainsense.llm import simhash
from plainsense.llm.bitslice import links
from plainsense.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def near_prints(seed, n, most=6):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 9)):
            out.add(base)
            for b in rnd.sample(range(64), rnd.randint(0, most)):
                base ^= 1 << b
    return sorted(out)[:n]


def test_links_of_one_group_and_of_two_sides():
    for seed in range(20):
        prints = near_prints(seed, 150)
        arr = np.array(prints, np.uint64)
        got = links(arr, np.zeros(150, np.int64), np.zeros(150, bool), 3).root
        assert got.tolist() == brute_roots(prints)
        side = np.arange(150) >= 70
        got = links(arr, np.zeros(150, np.int64), side, 3).root
        for a in range(70):
            for b in range(70, 150):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    assert got[a] == got[b]


def test_links_of_two():
    for n in (2, 3):
        assert links(np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, bool), 3).root.tolist() == [0] * n


def test_links_stay_within_groups():
    arr = np.zeros(10, np.uint64)
    group = np.array([1, 1, 2, 3, 3, 3, 4, 5, 6, 6])
    assert links(arr, group, np.zeros(10, bool), 3).root.tolist() == [0, 0, 2, 3, 3, 3, 6, 7, 8, 8]


def test_every_key_scheme_and_tile_size_finds_all_links(spark):
    prints = near_prints(7, 300)
    roots = brute_roots(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for n, tile in ((100, 4), (1 << 25, 8192), (1 << 34, 16)):
        found = components(simhash.near_links(nodes, 3, n, tile)).collect()
        of = {r.node: r.root for r in found}
        names = [of.get(x, x) for x in signed]
        classes, want = {}, {}
        for x, c in zip(signed, names, strict=True):
            classes.setdefault(c, set()).add(x)
        for x, c in zip(signed, roots, strict=True):
            want.setdefault(c, set()).add(x)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_documents_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 400]))]
        texts.append(" ".join(base))
        near = base[:]
        near[rnd.randrange(len(near))] = "changed"
        texts.append("\n".join(near))
    texts += [None, "", " \t", "One", "ONE two", texts[0], texts[0].upper(), "é À ß ñ", "x" * 300_000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, texts[0], "c", 1), (3, texts[3], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = simhash.near_dedup(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_roots(prints)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -1, p, least[c]) for r, p, c in zip(rows, prints, roots, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dedup(docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)}
