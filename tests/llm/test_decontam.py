import random

import numpy as np
import pytest

from plainsense.llm import decontam
from plainsense.llm.decontam import Index, _codes, align, clean, matches, normalise, windows


def semi_global(p, t):
    """Least edits of p against any stretch of t."""
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k = rnd.randrange(len(s))
        s[k : k + 1] = rnd.choice([[], [rnd.choice("abcdef")], [s[k], rnd.choice("abcdef")]])
    return "".join(s)


def test_alignment_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        p = "".join(rnd.choice("abcd") for _ in range(rnd.randint(10, 40)))
        lead = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 20)))
        t = lead + edited(rnd, p, rnd.randint(0, 5)) + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 20)))
        budget = 6
        got = align(_codes(p), _codes(t), -len(p), len(t), budget)  # all diagonals
        want = semi_global(p, t)
        assert (got[0] if got else None) == (want if want <= budget else None)


def test_filter_loses_no_window_within_its_budget():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [normalise(say(rnd.choice([6, 30, 60]))) for _ in range(12)]
    patterns = [(i, w) for i, t in enumerate(items) for w in windows(t) if len(w) >= 8]
    index = Index([_codes(w) for _, w in patterns], [i for i, _ in patterns], 8, 0.1)
    for k in range(60):
        item = rnd.choice(items)
        text = normalise(say(rnd.randint(0, 80)) + " " + edited(rnd, item, k % 12) + " " + say(rnd.randint(0, 80)))
        found = {w for w, *_ in index.find(_codes(text), segment=rnd.choice([50, 200_000]))}
        want = {n for n, (_, w) in enumerate(patterns) if semi_global(w, text) <= index.budget[n]}
        assert found == want


def test_matches_and_clean(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(40)) for i in range(20)] + [(20, "tiny"), (21, None), (22, ""), (None, say(30)), (3, say(40))]
    docs = [(i, say(100), "x") for i in range(40)]
    docs[5] = (5, say(50) + "\n\n" + items[7][1].upper().replace(" ", ",  ") + say(20), "x")
    docs[6] = (6, edited(rnd, items[8][1], 9), "x")
    docs[7] = (7, say(9) + " tiny " + say(9), "x")
    docs += [(40, None, "x"), (41, "", "x"), (5, docs[5][1], "x"), (None, items[23][1], "x"), (42, say(60_000) + items[9][1] + say(10), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    for block in (10**6, 500):
        got = {(r.doc_id, r.item_id) for r in matches(d, b, block=block).collect()}
        assert got == {(5, 7), (6, 8), (None, None), (42, 9)}
        left = clean(d, b, block=block)
        assert left.columns == d.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, *_ in docs if i not in (5, 6, 42, None))


@pytest.mark.parametrize("which", [0, 1])
def test_empty_tables(spark, which):
    d = spark.createDataFrame([] if which else [(1, "a" * 50)], "doc_id long, text string")
    b = spark.createDataFrame([] if not which else [(1, "a" * 50)], "item_id long, text string")
    assert matches(d, b).count() == 0 and clean(d, b).count() == d.count()


def test_every_stretch_of_an_item_is_in_a_window():
    t = "x" * 250
    assert [*map(len, windows(t))] == [96] * 5 and decontam.WINDOW == 96
    assert np.array_equal(_codes("a"), [97])


def test_every_excerpt_of_79_characters_is_found(spark):
    """Wherever it starts; windows of 96 characters alone find none of them."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(60)) for i in range(4)]
    docs = [(1000 * i + at, say(30) + " | " + t[at : at + 79] + " | " + say(30)) for i, t in items for at in range(len(t) - 78)]
    clean_docs = [(-1 - k, say(90)) for k in range(50)]
    d = spark.createDataFrame(docs + clean_docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in clean(d, b).collect()} == {i for i, _ in clean_docs}
    assert {(r.doc_id, r.item_id) for r in matches(d, b).collect()} == {(i, i // 1000) for i, _ in docs}


def test_edits_crowded_in_the_middle_of_an_item_are_allowed_as_before(spark):
    rnd = random.Random(8)
    t = "".join(rnd.choice("abcdefgh") for _ in range(96))
    d = spark.createDataFrame([(1, t[:44] + "XXXXXXXXX" + t[53:])], "doc_id long, text string")
    assert matches(d, spark.createDataFrame([(1, t)], "item_id long, text string")).count() == 1
