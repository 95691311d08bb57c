"""Reading raw listing payloads, in batch and as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobdelta.schema import PAYLOAD


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Payload rows from parquet or JSON lines, or from a folder of raw bodies.

    Raw bodies lie under `resource_id=…/adapter=…/page_no=…/`; each file is one body.
    """
    if fmt in ("parquet", "json", "orc"):
        return spark.read.schema(PAYLOAD).format(fmt).load(path)
    if fmt != "text":
        raise ValueError(f"unknown payload format {fmt!r}")
    files = spark.read.option("wholetext", True).option("basePath", path).option("recursiveFileLookup", False).text(path)
    have = set(files.columns)
    rows = files.withColumnRenamed("value", "body")
    for f in PAYLOAD.fields:
        if f.name not in have and f.name != "body":
            rows = rows.withColumn(f.name, F.lit(200 if f.name == "status" else None).cast(f.dataType))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields])


def stream_payloads(spark: SparkSession, path: str, schema: T.StructType = PAYLOAD, max_files: int = 1000) -> DataFrame:
    """The same rows as a stream over a folder new files land in; run it with `trigger(availableNow=True)`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def drop_not_modified(payloads: DataFrame, boards: DataFrame) -> DataFrame:
    """Payloads worth reading: not answered 304, and not carrying the validators accepted last time.

    Both tables have `etag` and `last_modified`; a board read for the first time always passes.
    """
    last = boards.filter("current_snapshot_id is not null") \
        .select("resource_id", F.col("etag").alias("last_etag"), F.col("last_modified").alias("last_date"))
    same = F.when(F.col("etag").isNotNull() & F.col("last_etag").isNotNull(), F.col("etag") == F.col("last_etag")) \
        .when(F.col("last_modified").isNotNull() & F.col("last_date").isNotNull(), F.col("last_modified") == F.col("last_date")) \
        .otherwise(F.lit(False))
    return payloads.join(last, "resource_id", "left") \
        .filter((F.coalesce("status", F.lit(200)) != 304) & ~same).select(*payloads.columns)
