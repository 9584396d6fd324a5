import math
import random
from collections import Counter, defaultdict

import pytest

from plainsense.llm import quality as q


def brute_model(texts, order):
    """p(gram) by the textbook recursion."""
    a = {order: Counter()}
    for t in texts:
        t = q.prepared(t, order)
        a[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    d = {k: q.discounts(*[sum(1 for n in a[k].values() if n == i) for i in (1, 2, 3, 4)]) for k in a}
    total, spare = defaultdict(int), defaultdict(float)
    for k in a:
        for g, n in a[k].items():
            total[k, g[:-1]] += n
            spare[k, g[:-1]] += d[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(a[1]) + 1)
        h = (k, g[:-1])
        n = a[k][g]
        if not total[h]:
            return p(g[1:])
        return ((n - d[k][min(n, 3) - 1]) / total[h] if n else 0) + spare[h] / total[h] * p(g[1:])

    return p, a


def brute_perplexity(p, text, order):
    t = q.prepared(text, order)
    logs = [math.log(p(t[i : i + order])) for i in range(len(t) - order + 1)]
    return math.exp(-sum(logs) / len(logs))


def corpus():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aabbcdé") for _ in range(rnd.randint(1, 6)))
    return [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(30)] + ["", None, "日本 \n\t x", "ZZZZ!!"]


@pytest.mark.parametrize("order", [2, 4])
@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_perplexities_against_brute_force(spark, order, broadcast):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, p double")
    trusted = docs.where("doc_id < 20")
    counts = q.grams(trusted, order).groupBy("gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    p, _ = brute_model(texts[:20], order)
    got = q.perplexities(docs, counts, order, broadcast=broadcast, group=7).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        assert r.perplexity == pytest.approx(brute_perplexity(p, t, order), rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    p, a = brute_model(corpus()[:20], 3)
    for h in ("aa", "éb", q.START * 2):
        assert sum(p(h + c) for c in a[1]) + p(h + "￿") == pytest.approx(1)


@pytest.mark.parametrize("ids", [q.BROADCAST_IDS, 0])
def test_thresholds_by_language(spark, ids, monkeypatch):
    monkeypatch.setattr(q, "BROADCAST_IDS", ids)
    rnd = random.Random(5)
    say = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(80))
    rows = [(i, say("abc" if i % 2 else "xyz"), "one" if i % 2 else "two") for i in range(600)]
    rows += [(1000 + i, say("%$#") + say("ABC"), "one") for i in range(10)] + [(2000, None, None), (2001, say("abc"), None), (3, rows[3][1], "one"), (None, say("abc"), "one")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, quality string")
    labels = spark.createDataFrame([(i, 1, "y") for i in range(600)] + [(1000, 0, "y"), (None, 1, "y"), (5, None, "y")], "doc_id long, quality int, text string")
    got = q.quality(docs, labels, least=20).collect()
    assert len(got) == len(rows)
    assert not any(r.kept for r in got if r.doc_id and 1000 <= r.doc_id < 2000)
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 600) > 590
    assert next(r.kept for r in got if r.doc_id == 2001)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.quality(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    got = q.quality(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"), labels).collect()
    assert [r.kept for r in got] == [True]
