"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, license_scan, line_dedup, packing, quality, simhash, suffix_dedup, toxicity
from ._shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_table(spark, table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("norm", 256)})


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, k AS keep_id, n AS group_size, doc_id = k AS kept, text_sha256
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k, count(*) OVER (PARTITION BY text_sha256) AS n FROM d)
"""


_TEMPLATES = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, '{t.text}')" for i, t in enumerate(license_scan.BASE + license_scan.NOTICES))

OP7_SQL = rf"""
WITH template(tid, label, base, phrase) AS (VALUES {_TEMPLATES}),
tw AS (SELECT tid, label, base, regexp_extract_all(phrase, '[a-z0-9]+') AS w FROM template),
tr AS (SELECT tid, label, base, len(w) - 2 AS runs, i AS tpos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS run FROM tw, unnest(generate_series(0, len(w) - 3)) u(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hit AS (SELECT r, tid, label, base, runs, tpos, i - tpos AS diagonal FROM (SELECT r, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS run FROM d, unnest(generate_series(0, len(w) - 3)) u(i)) JOIN tr USING (run)),
diagonals AS (SELECT DISTINCT r, tid, base, diagonal FROM hit),
far AS (SELECT r, tid, diagonal, coalesce(diagonal - lag(diagonal) OVER o > CASE WHEN base THEN 0 ELSE 2 END, true) AS far FROM diagonals WINDOW o AS (PARTITION BY r, tid ORDER BY diagonal)),
numbered AS (SELECT r, tid, diagonal, sum(CAST(far AS INTEGER)) OVER (PARTITION BY r, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM far),
spans AS (SELECT r, tid, any_value(label) AS label, any_value(base) AS base, min(diagonal) AS start, count(DISTINCT tpos) / any_value(runs) AS share FROM hit JOIN numbered USING (r, tid, diagonal) GROUP BY r, tid, span),
found AS (SELECT r, count(*) FILTER (base AND share = 1) AS n_base, min(start) FILTER (base AND share = 1) AS first_word, max(start) FILTER (base AND share = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN base THEN share = 1 ELSE share >= 0.8 END) AS labels, max(share) AS score FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (r)
"""

OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
start AS (SELECT r, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 400)) AS s FROM d, unnest(generate_series(0, length(x) // 2 - 200)) u(i)),
again AS (SELECT s FROM start GROUP BY s HAVING count(*) > 1),
repeated AS (SELECT r, i, 1 AS hit FROM start SEMI JOIN again USING (s)),
byte AS (SELECT r, i, substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS b FROM d, unnest(generate_series(0, length(x) // 2 - 1)) u(i)),
marked AS (SELECT r, i, b, coalesce(max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) AS gone FROM byte LEFT JOIN repeated USING (r, i)),
runs AS (SELECT *, gone > lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY i) AS first FROM marked),
kept AS (SELECT r, sum(gone) AS n, count(*) FILTER (first) AS spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS rest FROM runs GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_license_scan": op7_license_scan,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_suffix_array_dedup": OP10_SQL}
