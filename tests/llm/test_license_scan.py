import re

import pytest

from plainsense.llm.license_scan import BASE, NOTICES, scan

TEXTS = [
    "Released UNDER the MIT License. under the mit-license, under the  mit licens",
    "licensed under the Apache License, Version 2.0; cc by-nc 4.0 CC\nBY\tNC",
    "cc by", "", None, "under the éMIT license", "under the mİt license", "cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    NOTICES[0].text.replace("free of charge", "without any charge"),
    "x " * 50_000 + "cc by nc " + "y " * 1000,
    "under the mit license under the mit license",
]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for t in BASE:
        p = t.text.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(t.label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases_against_brute_force(spark):
    rows = [(i, t, "x", 0.0) for i, t in enumerate(TEXTS)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, w string, score double")).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [brute(t) for t in TEXTS]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_labels_of_the_method(spark):
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert got[8].labels == "gpl" and got[8].n_base == 0
    assert got[9].labels == "mit" and 0.8 <= got[9].score < 1
    assert got[1].labels == "apache-2,cc-by-nc"


@pytest.mark.parametrize("rows", [[], [(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc"), (1, "other")]])
def test_empty_and_repeated_rows(spark, rows):
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in got) == sorted((i or 0, int(t == "cc by nc")) for i, t in rows)


def test_plan_is_native(spark, capsys):
    scan(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
