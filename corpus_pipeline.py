"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and packing, one stage after another.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents that the next stage
reads, in the columns of ``documents``; the last returns the packed pieces. ``run`` writes every stage's result as
Parquet in the shared folder and reads it again, so a lost executor never sets the pipeline back by more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsense.llm import decontam, line_dedup, packing, shingle_dedup, toxicity
from plainsense.llm._shared import kept, table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score 0.5 or more go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of fuzzy-equal lines the first stays; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3's method, SimHashes compared bit-sliced, for five-word shingles: one document of each group stays.

    The radius is wide enough for a similarity of 0.8, which is then checked exactly. The query of operator 3 has its
    own figures (three-word shingles, radius 3).
    """
    return shingle_dedup.keep_one(docs)


def benchmark_leaks_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the rest is tokenized and packed."""
    return packing.packed_table(spark, docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", repeated_lines_go),
    ("near-dedup", near_copies_go),
    ("decontamination", benchmark_leaks_go),
    ("packing", packed),
]

#: No stage but the first's filter can be said in SQL (a learnt model, a similarity closure, alignment, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
