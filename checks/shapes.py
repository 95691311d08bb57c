"""Turns the input views into the columns the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.functions.text import is_remote, search_text, seniority
from jobdelta.operators.changes import assign_change_ids, diff_postings


def postings(df: DataFrame) -> DataFrame:
    """fx_now / fx_prev / fx_big rows as postings: structured pay, remote and seniority filled in."""
    has = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    pay = F.struct(
        has("annual_min", "double").alias("min"), has("annual_max", "double").alias("max"),
        has("currency", "string").alias("currency"), F.lit("year").alias("period"),
        has("annual_min", "bigint").alias("annual_min"), has("annual_max", "bigint").alias("annual_max"))
    out = df.select(
        "resource_id", "key", "title", has("location", "string").alias("location"), "department", "company",
        has("url", "string").alias("url"), has("posted_at", "string").alias("posted_at"), has("source", "string").alias("source"),
        F.lit(None).cast("array<string>").alias("other_locations"),
        F.when(F.coalesce(has("annual_min", "bigint"), has("annual_max", "bigint")).isNotNull(), pay).alias("salary"),
        has("experience_years", "double").alias("experience_years"),
        is_remote(F.col("title"), F.col("location")).alias("remote"), seniority(F.col("title")).alias("seniority"),
        F.coalesce(has("partial", "boolean"), F.lit(False)).alias("partial"),
        has("ordinal", "bigint").alias("ordinal"), has("complete", "boolean").alias("complete"))
    return out


def events(i) -> DataFrame:
    return diff_postings(postings(i.fx_prev), postings(i.fx_now))


def changes(i) -> DataFrame:
    return assign_change_ids(events(i))


def change_log(i) -> DataFrame:
    """Every current posting as one change, for the operators that read a change log."""
    p = postings(i.fx_open)
    fields = [c for c in p.columns if c not in ("resource_id", "complete")]
    kind = F.when(F.col("ordinal") % 5 == 0, "JOB_REMOVED").when(F.col("ordinal") % 5 == 1, "JOB_UPDATED").otherwise("JOB_ADDED")
    return p.select(
        (F.col("ordinal") + 1).alias("change_id"), F.concat(F.lit("k"), F.col("ordinal") % 97).alias("check_id"),
        F.expr("TIMESTAMP_NTZ '2026-10-01 00:00:00' + make_dt_interval(0, 0, 0, ordinal % 97)").alias("detected_at"), "resource_id", kind.alias("type"), F.col("key").alias("item_key"),
        F.struct(*fields).alias("job"), F.concat(F.lit("Posting "), "title").alias("summary"),
        search_text(*[F.col(c) for c in ("title", "location", "department", "company")]).alias("search_text"))
