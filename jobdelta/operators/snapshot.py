"""One board's postings as a snapshot: de-duplication, carry-forward, content hash, current version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobdelta.functions.text import is_remote, seniority
from jobdelta.schema import POSTING
from jobdelta.session import materialize

KEY = ["resource_id", "key"]


def dedupe_postings(postings: DataFrame, last: bool = True) -> DataFrame:
    """One row per key of a board: the last listed wins (or the first).

    Ranked in the exchange that a join on the key uses too. Spark keeps one row per key and map task before it, so
    many copies of one key never meet in one place.
    """
    order = F.col("ordinal").desc_nulls_last() if last else F.col("ordinal").asc_nulls_last()
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
    return postings.withColumn("_place", place).filter("_place = 1").drop("_place")


def finalize_postings(postings: DataFrame) -> DataFrame:
    """Derive remote and seniority, default `complete`, blank companies to the board's name if there is one."""
    out = postings.withColumns({
        "remote": is_remote(F.col("title"), F.col("location")),
        "seniority": seniority(F.col("title")),
    })
    if "complete" in out.columns:
        out = out.withColumn("complete", F.coalesce("complete", F.lit(True)))
    if "board_company" in out.columns:
        out = out.withColumn("company", F.coalesce(F.nullif("company", F.lit("")), F.col("board_company"))) \
            .drop("board_company")
    return out


def carry_forward(current: DataFrame, previous: DataFrame) -> DataFrame:
    """A partial posting whose key was seen in full before is replaced by that full posting.

    The listing position and the `complete` flag stay those of the current listing.
    """
    keep = {*KEY, "ordinal", "complete"}
    fields = [c for c in current.columns if c not in keep and c in previous.columns]
    known = previous.filter(~F.coalesce("partial", F.lit(False))) \
        .select(*KEY, F.struct(*fields).alias("known"))
    swap = F.coalesce("partial", F.lit(False)) & F.col("known").isNotNull()
    return current.join(known, KEY, "left").select(*[
        F.when(swap, F.col(f"known.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in current.columns
    ])


def content_hash(postings: DataFrame) -> DataFrame:
    """Hash of a board's posting set, independent of order and of `complete`.

    Each posting is hashed alone and the hashes are added up in four lanes, so a board of any
    size is reduced by partial sums instead of being gathered and sorted.
    """
    fields = [f.name for f in POSTING.fields if f.name in postings.columns and f.name not in ("resource_id", "ordinal")]
    digest = F.sha2(F.to_json(F.struct(*fields)), 256)
    lanes = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.sum(lane).cast("string").alias(f"h{i}") for i, lane in enumerate(lanes)]
    return postings.groupBy("resource_id").agg(F.count("*").alias("jobs_count"), *sums).select(
        "resource_id", "jobs_count",
        F.sha2(F.concat_ws(":", F.col("jobs_count").cast("string"), "h0", "h1", "h2", "h3"), 256).alias("content_hash"),
    )


def changed_boards(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Boards of `current` whose posting set differs from `previous` (or that have no previous one)."""
    now, before = content_hash(current), content_hash(previous)
    return now.join(before, ["resource_id", "content_hash"], "left_anti").select("resource_id", "content_hash")


def posting_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows in which two listings of the same boards differ, whole, with `sign`: -1 gone, 1 come.

    A posting that changed in any field is both. Digests meet in one aggregation with partial sums; equal rows cancel.
    """
    fields = [c for c in new.columns if c in old.columns and c not in (*KEY, "ordinal", "complete")]
    # Never null, so that no filter on it is made below the joins.
    digest = F.coalesce(F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), F.lit(""))
    sides = [df.withColumn("_d", digest) for df in (old, new)]
    net = sides[0].select(*KEY, "_d", F.lit(-1).alias("sign")).union(sides[1].select(*KEY, "_d", F.lit(1))) \
        .groupBy(*KEY, "_d").agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
    net = materialize(net, "delta")
    columns = [*KEY, *fields, *[c for c in ("ordinal", "complete") if c in old.columns and c in new.columns]]
    # Digests are made a second time for keys that differ only.
    parts = []
    for df, s in ((old, -1), (new, 1)):
        differ = net.filter(F.col("sign") * s > 0)
        rows = df.join(differ.select(*KEY), KEY, "left_semi").withColumn("_d", digest)
        parts.append(rows.join(differ, [*KEY, "_d"]).select(*columns, "sign"))
    return parts[0].unionByName(parts[1])


def current_snapshot(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per board (`resource_id`, `snapshot_id`, `fetched_at`, ...)."""
    rest = [c for c in snapshots.columns if c != "resource_id"]
    return snapshots.groupBy("resource_id").agg(
        F.max_by(F.struct(*rest), F.struct("fetched_at", "snapshot_id")).alias("s")
    ).select("resource_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def drop_stale(diffs: DataFrame, boards: DataFrame) -> DataFrame:
    """Keep the diffs whose base is still the board's current snapshot."""
    base = boards.select("resource_id", "current_snapshot_id")
    return diffs.join(base, "resource_id", "inner") \
        .filter(F.col("base_snapshot_id").eqNullSafe(F.col("current_snapshot_id"))) \
        .drop("current_snapshot_id")


def live(watches: DataFrame) -> DataFrame:
    return watches.filter(F.col("deleted_at").isNull()) if "deleted_at" in watches.columns else watches


def monitored(boards: DataFrame, watches: DataFrame) -> DataFrame:
    """Boards in the directory, or watched by a live watch."""
    watched = live(watches).filter("resource_id is not null").select("resource_id").distinct() \
        .withColumn("is_watched", F.lit(True))
    return boards.join(watched, "resource_id", "left") \
        .filter(F.coalesce("indexed", F.lit(False)) | F.coalesce("is_watched", F.lit(False))).drop("is_watched")


def open_postings(boards: DataFrame, watches: DataFrame, postings: DataFrame) -> DataFrame:
    """Current postings of the monitored boards."""
    return postings.join(monitored(boards, watches).select("resource_id"), "resource_id", "left_semi")


def tracked_changes(before, after, fields: list[str]) -> Column:
    """Names of the fields that differ null-safely, in the given order."""
    hits = [F.when(~before(f).eqNullSafe(after(f)), F.lit(f)) for f in fields]
    return F.filter(F.array(*hits), lambda f: f.isNotNull())
