"""Exact de-duplication by sorting content, in DataFrame functions only.

Sampled splitters range-partition the rows by their normalised text, an external sort brings equal texts next
to each other, and neighbours are compared in full. Splitters hold the first characters and a hash of a text,
so that samples stay small however long texts are; the sort and the comparison use whole texts.

A text whose copies hold more than a share of one partition is split into several runs. Each run is reduced by
the same comparison; the runs of a text, few by construction, are then merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobdelta.llm.common import written

HEAD = 24  # characters of a text in a splitter


def normalised(text: Column) -> Column:
    """The text without blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\x0b\x0c\r", text)


def mark_copies(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256; with `keep_rows` also `row`, the
    whole input row as a struct, whatever its columns are called.

    Texts are equal when their normalised texts are; null counts as empty, and all empty texts are equal. Of equal
    texts the row with the most characters stays, then the one with the smallest doc_id (null last). Of repeated
    rows exactly one is kept, and each counts in group_size. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                         *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("__null")).alias("rest")] if keep_rows else []))
    norm = normalised(F.col("text"))

    # Texts with more bytes than half a partition's share: at most 2 * parts of them, whatever the data.
    volumes = source.select(F.xxhash64(norm).alias("digest"), (F.octet_length("text") + 64).alias("bytes")).groupBy("digest").agg(F.sum("bytes").alias("bytes"))
    volumes = written(volumes, "exact-volumes")
    share = (volumes.agg(F.sum("bytes")).first()[0] or 0) // (2 * parts) + 1
    hot = volumes.filter(F.col("bytes") > share).select("digest", F.ceil(F.col("bytes") / share).cast("int").alias("runs"))

    keyed = source.withColumn("digest", F.xxhash64(norm)).join(F.broadcast(hot), "digest", "left") \
        .withColumn("run", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("runs")), F.lit(-1)).cast("int")).drop("runs")
    # The text travels once; its normalised form is derived again behind the exchange.
    dealt = keyed.withColumn("head", F.substring(norm, 1, HEAD)).repartitionByRange(parts, "head", "digest", "run").withColumn("norm", norm)
    equal = Window.partitionBy("head", "digest", "run", "norm")
    ordered = equal.orderBy(F.length("text").desc(), F.col("doc_id").asc_nulls_last())
    runs = dealt.select(
        "doc_id", *(["rest", "text"] if keep_rows else []), "run", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.row_number().over(ordered).alias("place"), F.first("doc_id").over(ordered).alias("run_keep"),
        F.first(F.length("text")).over(ordered).alias("run_chars"), F.count(F.lit(1)).over(equal).alias("run_size"))
    runs = written(runs, "exact-runs")

    # Runs of split texts, one row each. Of a text, the first run in the order of the rows holds the row that stays.
    heads = runs.filter("run >= 0 and place = 1").groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("run_chars")).alias("c"), F.col("run_keep").isNull().alias("n"), F.col("run_keep").alias("id"), F.col("run"))).alias("best"), F.sum("run_size").alias("all"))
    split = runs.join(F.broadcast(heads), "text_sha256", "left")  # at most as many as there are hot texts
    whole = F.col("best").isNull() | (F.col("run") < 0)
    out = split.select(
        "doc_id", F.when(whole, F.col("run_keep")).otherwise(F.col("best.id")).alias("keep_id"),
        F.when(whole, F.col("run_size")).otherwise(F.col("all")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & (whole | (F.col("run") == F.col("best.run")))).alias("kept"), "text_sha256",
        *(["rest", "text"] if keep_rows else []))
    if not keep_rows:
        return out
    fields = [F.when(F.col("rest.__null"), F.lit(None)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.withColumn("row", F.struct(*fields)).drop("rest", "text")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
  FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
