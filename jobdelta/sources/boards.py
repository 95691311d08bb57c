"""Board and company lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobdelta.functions.urls import is_url


def read_board_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) board addresses, one per line; `#` starts a comment and blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("url")).filter("url <> ''")
    http = is_url(F.col("url")) & F.rlike(F.lower("url"), F.lit("^https?://"))
    return lines.filter(http), lines.filter(~http)


def read_companies(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Companies (name, website) from a JSON array, or from JSON lines for long lists; nameless ones are dropped."""
    rows = spark.read.schema("name string, website string").option("multiLine", multi_line).json(path)
    return rows.filter(F.trim(F.coalesce("name", F.lit(""))) != "").select("name", "website")


def write_board_list(boards: DataFrame, path: str) -> None:
    """Confirmed boards, one per address whatever its case, sorted, as text and as JSON."""
    row = F.struct(*[c for c in boards.columns if c != "board"])
    unique = boards.groupBy(F.lower("board").alias("k")).agg(F.max_by(F.struct("board", row.alias("r")), F.col("board")).alias("b")) \
        .select("b.board", "b.r.*").orderBy("board")
    unique.select("board").write.mode("overwrite").text(f"{path}/text")
    unique.write.mode("overwrite").json(f"{path}/json")
