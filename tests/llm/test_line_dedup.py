import random

import numpy as np

from plainsense.llm import line_dedup as ld


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(rows, least=ld.SIMILARITY, found=None):
    """Texts after removal, by comparing all pairs of lines by edit distance alone, or those that ``found`` lets through."""
    places = []
    for at, (i, t) in enumerate(rows):
        for k, x in enumerate(ld.normalised_lines(t or "")):
            if len(x) >= ld.MIN_CHARS:
                places.append(((i is None, i or 0, at, k), x))
    places.sort()
    root = list(range(len(places)))
    near = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(places)):
        for b in range(a):
            x, y = places[a][1], places[b][1]
            if x != y and (x, y) not in near:
                short = min(len(x), len(y)) < least * max(len(x), len(y))
                near[x, y] = not short and (found is None or found(x, y)) and ld.edit_distance(x, y) <= (1 - least) * max(len(x), len(y)) + 1e-9
            if x == y or near[x, y]:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    gone = {places[a][0][2:] for a in range(len(places)) if find(a) != a}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (at, k) not in gone) for at, (_, t) in enumerate(rows)]


def parts_of(lines):
    of, prints = ld.part_prints(lines)
    out = [set() for _ in lines]
    for i, p in zip(of.tolist(), prints.tolist(), strict=True):
        out[i].add(p)
    return out


def candidates(rows):
    lines = sorted({x for _, t in rows for x in ld.normalised_lines(t or "") if len(x) >= ld.MIN_CHARS})
    parts, prints = dict(zip(lines, parts_of(lines), strict=True)), dict(zip(lines, ld.line_prints(lines), strict=True))

    def found(x, y):
        few = min(len(x.split()), len(y.split())) < ld.FEW
        return bool(parts[x] & parts[y]) and (few or np.bitwise_count(prints[x] ^ prints[y]).sum() <= ld.RADIUS)

    return found


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(600)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    pool = [say(rnd.randint(3, 60)) for _ in range(25)]

    def line():
        if rnd.random() < 0.4:
            return say(rnd.randint(1, 50))
        x = rnd.choice(pool).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            x[rnd.randrange(len(x))] = rnd.choice([rnd.choice(words), "7", "UP,"])
        return " ".join(x).capitalize() + rnd.choice(["", ".", " !"])

    rows = [(i, "\n".join(line() for _ in range(rnd.randint(1, 8)))) for i in range(60)]
    return rows + [(60, ""), (61, None), (62, "\n\n \n"), (63, rows[4][1]), (None, rows[5][1]), (64, "Page 12 of 90\n\nshort\nPAGE 13 of 91\nshort"), (65, "z" * 200_000 + "\n" + "z" * 200_000)]


def test_against_brute_force(spark):
    rows = corpus()
    rows[64 + 2] = rows[64 + 2][:1] + ("z" * 2000 + "\n" + "z" * 2000,)  # the plain distance of 200,000 letters takes too long
    docs = spark.createDataFrame([(*r, "c", 1, "l") for r in rows], "doc_id long, text string, h string, key int, lines string")
    texts = brute(rows, found=candidates(rows))
    want = sorted(map(str, zip([r[0] for r in rows], texts, strict=True)))
    assert sum(a != b for (_, a), b in zip(rows, texts, strict=True)) > 20
    everything = brute(rows)  # without any SimHash: hardly a line more is found
    assert sum(len(x or "") for x in everything) >= 0.97 * sum(len(x or "") for x in texts)
    for tile in (1024, 3):
        out = ld.line_dedup(docs, tile=tile)
        assert out.columns == docs.columns
        got = sorted(str((r.doc_id, r.text)) for r in out.collect())
        assert got == want


def test_recall_by_length_without_simhash():
    """Lines with one word replaced whose edit similarity is 0.8 or more: nine of ten are candidates in every band."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([2, 3, 4, 5, 6, 7, 9, 11]))) for _ in range(4000)]
    for low, high in ((3, 10), (11, 20), (21, 40), (41, 80), (81, 200)):
        for share in (0, 0.1):
            pairs = []
            while len(pairs) < 150:
                x = [rnd.choice(words) for _ in range(rnd.randint(low, high))]
                y = list(x)
                for i in rnd.sample(range(len(x)), max(1, int(share * len(x)))):
                    y[i] = rnd.choice(words)
                a, b = " ".join(x), " ".join(y)
                if a != b and ld.edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
                    pairs.append((a, b))
            left, right = [a for a, _ in pairs], [b for _, b in pairs]
            apart = np.bitwise_count(ld.line_prints(left) ^ ld.line_prints(right)).sum(1)
            hit = [bool(p & q) and (d <= ld.RADIUS or len(a.split()) < ld.FEW) for p, q, d, a in zip(parts_of(left), parts_of(right), apart, left, strict=True)]
            assert np.mean(hit) >= 0.9, (low, share, np.mean(hit))


def test_scripts_without_blanks_and_long_lines(spark):
    a = "これは長い日本語の文章であり同じ内容が何度も現れることがあります"
    long = " ".join(f"word{i % 977}x{'abc'[i % 3]}" for i in range(60_000))
    rows = [(1, a), (2, a[:20] + "短" + a[21:]), (3, "全然違う内容の文章なので残るはずです今日は天気がいい"), (4, long), (5, long[:2000] + "changed" + long[2007:])]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: a, 2: "", 3: rows[2][1], 4: long, 5: ""}


def test_numbers_stay():
    assert ld.normalised_lines("12345678\nPage 12 of 90") == ["12345678", "page 00 of 00"]


def test_hot_line(spark):
    """A line that half of all rows share."""
    rows = [(i, f"the same boiler plate line here\nand one of its own {chr(97 + i % 26) * 9} {chr(97 + i // 26) * 8}") for i in range(300)]
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()
    assert sum("boiler" in r.text for r in got) == 1 and sum(r.n_removed for r in got) >= 299


def test_repeated_rows_and_counts(spark):
    t = "this line is here twice\nand this one is not\nThis line is here: twice"
    docs = spark.createDataFrame([(1, t), (1, t), (2, "this line is here twice")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in ld.line_dedup(docs, counts=True).collect())
    assert got == [(1, "this line is here twice\nand this one is not", 3, 1)] * 2 + [(2, "", 1, 1)]


def test_empty_table(spark):
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edit_distance_and_prints():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        d = levenshtein(a, b)
        assert ld.edit_distance(a, b) == d
        assert (ld.edit_distance(a, b, 20) <= 20) == (d <= 20)
    lines = ["ab cd", "ab", "", "x y z ab cd", "a " * 70_000 + "b"]
    prints = ld.line_prints(lines)
    for x, got in zip(lines, prints.tolist(), strict=True):
        h = np.unique(ld._pairs(ld.words_and_sizes(x.encode())[0]))
        for half in range(2):
            ones = [sum(int(v) >> i & 1 for v in ld.mix(h + np.uint64(1 + half))) for i in range(64)] if len(h) < 100 else None
            assert ones is None or got[half] == sum(1 << i for i in range(64) if 2 * ones[i] > len(h))


def test_edit_distances_side_by_side():
    """Pairs taken together have the answers that each has alone, whatever their lengths, letters and bounds."""
    rnd = random.Random(5)
    pairs, most = [], []
    for k in range(900):
        a = "".join(rnd.choice("abcdé語😀 "[: 2 + k % 7]) for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 130, 200, 500])))
        b = list(a)
        for _ in range(rnd.randint(0, 1 + len(a) // 3)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "x", "a"])
        pairs.append((a, "".join(b)))
        most.append(max(0, ld.edit_distance(*pairs[-1]) + rnd.choice([-30, -2, -1, 0, 1, 20])))
    got = ld.all_within(pairs, most)
    assert got.tolist() == [ld.edit_distance(a, b) <= n for (a, b), n in zip(pairs, most, strict=True)]
    assert 200 < got.sum() < 800


def test_pairs_in_doubt_join_groups(spark):
    """Lines of one part that only the edit distance tells apart or joins, more than are taken at once."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(40)]
    base = [*words[:4], *(rnd.choice(words) for _ in range(20))]

    def line():
        x = [w if k < 4 or rnd.random() < 0.5 else w[:4] + rnd.choice("stuvwxyz") * rnd.randint(1, 5) + w[5:] for k, w in enumerate(base)]
        return " ".join(x)

    rows = [(i, line()) for i in range(150)]
    got = sorted((r.doc_id, r.text) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [t for _, t in got] == brute(rows, found=candidates(rows))


def test_band_has_the_answers_of_the_whole_table():
    rnd = random.Random(2)
    for t in range(600):
        a = "".join(rnd.choice("abcdé語😀 "[: 2 + t % 7]) for _ in range(rnd.choice([3, 5, 20, 64, 65, 130, 300])))
        b = list(a)
        for _ in range(rnd.randint(0, 1 + len(a) // 3)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "x", "a"])
        a, b = sorted((a, "".join(b)), key=len)
        d = ld.edit_distance(a, b)
        for most in (d - 4, d - 1, d, d + 1, d + 5):
            if len(b) - len(a) <= most < len(a):
                assert ld._in_band(a, b, most) == (d <= most)


def test_sure_is_right_whatever_the_ends():
    """What both lines have at either end is left out, without a word being taken for another."""
    rnd = random.Random(4)
    for _ in range(3000):
        a = " ".join(rnd.choice(["ab", "abc", "b", "c d", "xyz", "the"]) for _ in range(rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "x", " ", "ab"])
        b = "".join(b)
        d = ld.edit_distance(a, b)
        assert ld.bound(a, b) >= d
        assert ld.surely(a, b, 0.8) in (None, d <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_normalised_as_each_line_alone():
    rnd = random.Random(8)
    for _ in range(3000):
        t = "".join(rnd.choice("aB1 23\n\t.²³¼ª\xa0\x85\x1cé_ÄÀ0ﬁ٣"[: rnd.choice([8, 14, 20, 24])]) for _ in range(rnd.randint(0, 60)))
        assert ld.normalised_lines(t) == [ld.normalised(x) for x in t.split("\n")]


def test_one_cluster_takes_few_distances(spark, monkeypatch):
    """60 lines of one part, all alike by edit distance alone: about as many distances as lines, not as pairs."""
    import pyarrow as pa
    from unittest.mock import MagicMock

    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(12)]
    lines = sorted({" ".join(w[:3] + rnd.choice("stuvwxyz") + w[4:] for w in base) for _ in range(60)})
    prints = ld.line_prints(lines).view(np.int64)
    n = len(lines)
    rows = {"id": range(n), "g": [1] * n, "_right": [False] * n, "norm": lines, "few": [True] * n, "p": prints[:, 0], "q": prints[:, 1], "k": [5] * n, "ks": [[5]] * n}
    taken = []
    real = ld.all_within
    monkeypatch.setattr(ld, "all_within", lambda pairs, most: taken.extend(pairs) or real(pairs, most))
    monkeypatch.setattr(ld, "map_texts", lambda df, run, *_: run)
    run = ld._verified(MagicMock(), 0.8)
    out = pa.Table.from_batches(run(iter(pa.table(rows).to_batches())))
    assert len(set(out["b"].to_pylist())) == 1 and out.num_rows == n - 1
    assert n - 1 <= len(taken) < 3 * n


def test_long_text_loses_a_line(spark):
    """A text of many lines is cut into lines once."""
    lines = [str(i) for i in range(20_000)] + ["this line is here twice"] * 2
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ld.line_dedup(docs, counts=True).collect()}
    assert got[1].text == "\n".join(lines[:-1]) and (got[1].n_lines, got[1].n_removed) == (20_002, 1) and got[2].text is None
