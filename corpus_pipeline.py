"""From raw documents to packed training sequences: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobdelta.llm import exact_dedup, language, near_dedup, packing, toxicity
from jobdelta.llm.common import unused, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest labelled examples call toxic. Null and empty texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = unused(docs, "found")
    return toxicity.with_score(docs, model, found).filter(F.col(f"{found}.score") < 0.5).drop(found)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those foreign to every language of the corpus. Without any row to learn from all stay."""
    model = language.fit(docs)
    if not model.languages:
        return docs
    found = unused(docs, "found")
    fits = (F.col(f"{found}.lang_pred") != language.UNKNOWN) & ~F.col(f"{found}.foreign")
    return language.with_language(docs, model, found).filter(fits).drop(found)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: the longest, then the one of smallest id."""
    return exact_dedup.mark_copies(docs, keep_rows=True).filter("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates; documents without an id stay."""
    gone = near_dedup.near_groups(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(written(gone, "near-gone"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    pieces = packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "packing-pieces")
    return packing.place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the first stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
