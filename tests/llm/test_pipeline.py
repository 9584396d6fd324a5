import corpus_pipeline
import test_line_dedup
import test_simhash
from test_decontam import semi_global

from plainsense.llm import decontam, simhash, toxicity
from plainsense.llm._shared import kept

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "line dedup", "near-dedup", "decontamination", "packing"]

    def step(name):
        before = docs.orderBy("doc_id").collect()
        after = kept(stages[name](spark, docs, SF), "test")
        return before, after, after.orderBy("doc_id").collect()

    before, docs, after = step("toxicity")
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r, s in zip(before, model.score([r.text for r in before]), strict=True) if s >= 0.5}
    assert docs.columns == COLUMNS and after == [r for r in before if r.doc_id not in bad]

    before, docs, after = step("line dedup")
    assert docs.columns == COLUMNS
    rows = [(r.doc_id, r.text) for r in before]
    assert [r.text for r in after] == test_line_dedup.brute(rows, found=test_line_dedup.candidates(rows))
    assert all(r.n_chars == len(r.text) for r in after)

    before, docs, after = step("near-dedup")
    roots = test_simhash.brute_roots([test_simhash.brute_fingerprint(r.text) for r in before])
    assert docs.columns == COLUMNS and after == [r for k, r in enumerate(before) if roots[k] == k]

    before, docs, after = step("decontamination")
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    texts = {r.doc_id: decontam.normalise(r.text) for r in before}
    assert docs.columns == COLUMNS
    assert gone >= {i for i, t in texts.items() if any(x in t for x in items if len(x) >= 40)}
    for i in gone:
        assert any(semi_global(w, texts[i]) <= 0.1 * len(w) for x in items for w in decontam.windows(x) if w[:12] in texts[i] or w[-12:] in texts[i])

    before, _, after = step("packing")
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_keep_one_with_nulls_and_repeated_rows(spark):
    rows = [(2, "a b c d", 1), (1, "A b c d", 2), (None, "a b c d", 3), (5, "x y z", 4), (5, "x y z", 4), (None, "only null", 5), (None, "only null", 6), (9, None, 7), (8, "", 8)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, [(1, "A b c d"), (5, "x y z"), (None, "only null"), (8, "")]))


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_odd_tables_through_the_stages(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, clashing names; and empty tables."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, h int, _key string, lines string"
    rows = [(1, "a text of some words here", "en", "s", 25, "k", 1, "x", "y"), (None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, None, None, None, None), (2, "", "en", None, 0, None, None, None, None), (3, "one more text of other words\nand a line", None, "s", 40, "k", 2, "x", "y")]
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, table in (("full", rows), ("none", [])):
        base = tmp_path / name
        spark.createDataFrame(table, columns).write.parquet(str(base / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (None, None, None)][: len(table)], labels).write.parquet(str(base / "labels.parquet"))
        spark.createDataFrame([(1, None), (None, "short")][: len(table)], items).write.parquet(str(base / "benchmark.parquet"))
        docs = spark.read.parquet(str(base / "documents.parquet"))
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            before, docs = docs.columns, kept(fn(spark, docs, str(base)), "odd")
            assert docs.columns == before, stage
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(base))
        assert {str(r.doc_id) for r in docs.collect()} == {str(r.doc_id) for r in packed.collect()}
        if table:
            assert {"1", "3"} <= {str(r.doc_id) for r in docs.collect()}
        else:
            assert docs.count() == 0
