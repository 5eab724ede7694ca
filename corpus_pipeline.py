"""Documents to training batches: quality rules, toxicity, line dedup, n-gram near duplicates, packing.

Every stage reads what its predecessor kept, is written as Parquet and read again. All but the last return the columns of
``documents``. A learned classifier and MinHash are not expressible in SQL, so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from guidescape.llm import line_dedup, ngram_join, packing, quality, toxicity
from guidescape.llm.text import A_WORD
from guidescape.runtime import ensure_checkpoint_dir

ORACLE_SQL = None

WORDS, PERCENT = 5, 80  # shingles and similarity of near duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    kept = quality.measure(rows, carried=("_row",)).where(quality.passes(quality.failure_bits()))
    return kept.select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    score = toxicity.scorer(spark, toxicity.fit(docs, labels))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut down to the lines that no other line stands for; n_chars follows the text.

    A document of which no word is left is a copy of others, line by line, and goes.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    shorter = line_dedup.line_dedup(rows).where((F.col("n_dropped") == 0) | F.col("text").rlike(A_WORD))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)}
    return shorter.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five words, a similarity of 0.8), the one that names the group."""
    groups = ngram_join.ngram_components(docs, WORDS, PERCENT)
    others = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone"))
    return docs.join(others, docs["doc_id"] == others["_gone"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket and batch."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", one_of_each_group),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
