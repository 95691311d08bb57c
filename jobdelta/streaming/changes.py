"""Change detection as payloads land.

Every micro-batch runs the batch diff against the stored snapshot, so a board's postings are spread over the
cluster instead of sitting in one task's state, and the events equal those of checks run one by one. Of the stored
snapshot only the buckets of the batch's boards are read; of the stored hashes only the boards themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from jobdelta.operators.snapshot import drop_stale
from jobdelta.plans.check import compare_checks
from jobdelta.session import materialize
from jobdelta.sources.sinks import _exists, _fs, _put, drop_versions, read_snapshot, stored_number, write_changes, write_snapshot

#: Versions of a snapshot that stay, for readers of the one before.
KEPT_VERSIONS = 3


def stream_changes(
    stream: DataFrame, root: str, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], trigger: dict | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start a query that writes change events to `root/changes` and keeps `root/snapshot` and `root/boards` current.

    `extract` turns a micro-batch into (postings, boards). Events of a batch go to a folder of their own that a
    retry finds complete or writes anew, so a retried batch emits nothing twice. `root/boards` holds for each board
    the hash of its listing, whether it is whole, and the batch that saw it.
    """
    spark = stream.sparkSession

    def stored(name: str, boards: DataFrame) -> DataFrame | None:
        return read_snapshot(spark, f"{root}/{name}", boards) if _exists(spark, f"{root}/{name}") else None

    def step(batch: DataFrame, epoch: int) -> None:
        postings, boards = extract(batch)
        boards = materialize(boards, "boards")
        out = f"{root}/changes/batch={epoch}"
        number = stored_number(spark, f"{root}/boards")
        known, previous = stored("boards", boards), stored("snapshot", boards)
        check = compare_checks(postings, boards, postings.limit(0) if previous is None else previous, _high_water(spark, root, epoch), known)
        if stored_number(spark, f"{root}/boards") != number:
            # Another writer moved boards meanwhile: what was compared with a listing that is no longer theirs is dropped.
            sound = materialize(_sound(boards, known, stored("boards", boards)), "sound")
            keep = lambda df: df.join(sound, "resource_id", "left_semi")
            boards = keep(boards)
            check = check._replace(changes=keep(check.changes), postings=keep(check.postings), boards=boards, hashes=keep(check.hashes))
        # Carrying over twice changes nothing, so a retry after the snapshot was replaced finds its events and goes on.
        if not _exists(spark, f"{out}/_SUCCESS"):
            write_changes(check.changes, out, F.coalesce("detected_at", F.current_timestamp()), mode="overwrite")
        top = spark.read.parquet(out).agg(F.max("change_id")).first()[0] if check.changes.take(1) else None
        if top is not None:
            _put(spark, f"{root}/marks/{epoch}", str(top))
        ok = boards.filter(~F.col("failed"))
        write_snapshot(check.postings, f"{root}/snapshot", boards=ok)
        state = ok.groupBy("resource_id").agg(F.max_by("complete", "fetched_at").alias("complete")).join(check.hashes, "resource_id", "left")
        write_snapshot(state.withColumn("current_snapshot_id", F.lit(str(epoch))), f"{root}/boards", boards=ok)
        for name in ("snapshot", "boards"):
            drop_versions(spark, f"{root}/{name}", keep=KEPT_VERSIONS)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{root}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _sound(boards: DataFrame, base: DataFrame | None, now: DataFrame | None) -> DataFrame:
    """resource_id of the boards whose stored listing is still the one that was read."""
    ids = boards.select("resource_id").distinct()

    def with_id(state: DataFrame | None, name: str) -> DataFrame:
        if state is None:
            return ids.withColumn(name, F.lit(None).cast("string"))
        return ids.join(state.select("resource_id", F.col("current_snapshot_id").alias(name)), "resource_id", "left")

    return drop_stale(with_id(base, "base_snapshot_id"), with_id(now, "current_snapshot_id")).select("resource_id")


def _high_water(spark: SparkSession, root: str, epoch: int) -> int:
    """The greatest change id of the batches before this one, from a small file that each of them leaves."""
    if not _exists(spark, f"{root}/marks"):
        return 0
    fs, p = _fs(spark, f"{root}/marks")
    done = [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit() and int(n) < epoch]
    return int(spark.read.text(f"{root}/marks/{max(done, key=int)}").first()[0]) if done else 0


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/changes")
