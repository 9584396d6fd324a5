import re
from collections import defaultdict

import pytest

from plainsense.llm import exact_dedup as ed

ROWS = [(1, "a b"), (2, "ab "), (3, " a\tb\n"), (4, "A b"), (5, ""), (6, None), (7, " \r\n"), (8, "x" * 100 + "1"), (9, "x" * 100 + "2"), (10, "x" * 100 + " 1"), (11, " ab"), (None, "lone"), (None, "ab"), (12, "q" * 300_000), (13, "q" * 300_000 + " "), (2, "ab ")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    keep = {k: min(v) for k, v in groups.items()}
    return [(i, keep[n][3], len(groups[n]), keep[n][3] == i) for i, t in rows for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]]


@pytest.mark.parametrize("keys", [ed.BROADCAST_KEYS, 0])
@pytest.mark.parametrize("prefix", [64, 2])
def test_against_brute_force(spark, keys, prefix):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, norm string, group_size int")
    got = [tuple(r) for r in ed.exact_dedup(docs, prefix_chars=prefix, broadcast_keys=keys).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(ROWS)))


def test_empty_table(spark):
    assert ed.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
