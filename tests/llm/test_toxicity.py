import math
import random
import zlib

import numpy as np

from plainsense.llm import toxicity as tx


def corpus(n=900):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.choice([10, 60, 300]))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Vile,", "AWFUL", "nasty!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(5000, None), (5001, ""), (None, "vile awful nasty"), (3, rows[3][1]), (5002, "vile " * 100_000), (5003, "plain words é")]
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, score string, toxic int")
    marks = spark.createDataFrame([(*r, "y") for r in labels] + [(5000, None, "y"), (None, 1, "y"), (5001, 7, "y")], "doc_id long, toxic int, text string")
    got = tx.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    of = {r.doc_id: r for r in got}
    assert of[5002].predicted == 1 and of[None].predicted == 1 and of[5000].score == of[5001].score < 0.5
    left = tx.reject_toxic(docs, marks)
    assert left.columns == docs.columns
    assert left.count() == sum(1 - r.predicted for r in got)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (tx.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.toxicity(spark.createDataFrame([], "doc_id long, text string"), empty).count() == 0
    got = tx.toxicity(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), empty).collect()
    assert [(r.score, r.predicted) for r in got] == [(0, 0)] or got[0].score < 1e-10


def plain_ftrl(rows, s):
    """One coordinate at a time, in dicts."""
    seen = {}
    for f, _ in rows:
        for i in f.tolist():
            seen[i] = seen.get(i, 0) + 1
    rows = [([i for i in f.tolist() if seen[i] >= s.min_rows] + ["bias"], y) for f, y in rows]
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == "bias" else s.l1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(min(s.most_passes, max(2, -(-s.examples // len(rows))))):
        for k in order.permutation(len(rows)):
            f, y = rows[k]
            w = {i: weight(i) for i in f}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in f:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_equal_a_plain_ftrl():
    rnd = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        y = int(rnd.random() < 0.4)
        f = set(rnd.integers(0, 40, 8).tolist()) | ({99} if y else set())
        rows.append((np.array(sorted(f), np.uint32), y))
    s = tx.Settings(l1=0.5, examples=200, min_rows=3)
    got, want = tx.train(rows, s), plain_ftrl(rows, s)
    assert abs(got.intercept - want.pop("bias", 0.0)) < 1e-9
    assert got.keys.tolist() == sorted(want) and np.allclose(got.weights, [want[k] for k in sorted(want)])


def test_the_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"good words number {i} and {'trash idiot' if i % 3 == 0 else 'kind friend'} {i % 7}") for i in range(90)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    s = tx.Settings(l1=0.5, examples=300, min_rows=2)
    models = [tx.learn(docs.repartition(n), labels, 1000, s, 400) for n in (1, 7)]
    assert models[0].keys.tolist() == models[1].keys.tolist() and models[0].weights.tolist() == models[1].weights.tolist()
