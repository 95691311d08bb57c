"""Change events: the difference of two snapshots, pairing, capping, and id assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobdelta.functions.text import event_summary, search_text
from jobdelta.operators.snapshot import KEY, dedupe_postings, tracked_changes
from jobdelta.schema import JOB_ADDED, JOB_REMOVED, JOB_UPDATED, TRACKED_FIELDS
from jobdelta.session import materialize


def _digest() -> Column:
    """Hash of the tracked fields, each told from a missing one."""
    missing = F.concat(*[F.when(F.col(f).isNull(), F.lit("1")).otherwise(F.lit("0")) for f in TRACKED_FIELDS])
    return F.xxhash64(*[F.col(f) for f in TRACKED_FIELDS], missing)


def _touched(prev: DataFrame, cur: DataFrame, complete: DataFrame | None) -> DataFrame:
    """resource_id, key, complete of every posting that may differ, of boards that are present on both sides.

    Both sides meet as (board, key, side, digest) in one aggregation with partial sums; rows that repeat a key are
    told by their count, so a key is left out only where all its rows on both sides agree. A board without a previous
    snapshot drops out: its first listing is a baseline.
    """
    flag = F.coalesce("complete", F.lit(True)) if "complete" in cur.columns else F.lit(True)
    sides = prev.select(*KEY, F.lit(0).alias("side"), _digest().alias("d"), F.lit(True).alias("whole")) \
        .unionByName(cur.select(*KEY, F.lit(1).alias("side"), _digest().alias("d"), flag.alias("whole")))
    keys = sides.groupBy(*KEY).agg(F.min("side").alias("first"), F.max("side").alias("last"), F.min("d").alias("low"), F.max("d").alias("high"), F.bool_and("whole").alias("whole"))
    keys = materialize(keys.withColumn("differs", (F.col("first") == F.col("last")) | (F.col("low") != F.col("high"))), "keys")
    boards = keys.groupBy("resource_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bool_and("whole").alias("complete"))
    if complete is None:
        boards = boards.filter("first = 0 and last = 1").select("resource_id", "complete")
    else:
        boards = complete.select("resource_id", "complete").join(boards.filter("first = 0").select("resource_id"), "resource_id", "left_semi")
    return materialize(keys.filter("differs").select(*KEY).join(boards, "resource_id"), "touched")


def _rows(side: DataFrame, touched: DataFrame, name: str, unique: bool) -> DataFrame:
    """The whole row of each touched key on one side: the last listed."""
    fields = [c for c in side.columns if c not in ("resource_id", "complete")]
    found = side.join(touched.select(*KEY), KEY, "left_semi")
    return (found if unique else dedupe_postings(found)).select(*KEY, F.struct(*fields).alias(name))


def pair_unique(loose: DataFrame, by: list[str]) -> DataFrame:
    """(by, before_key, after_key) of a removed and an added row of (by, key, added) that agree on `by`, where the match is unique on both sides.

    One aggregation with partial sums reads `loose` once, slim: counts of both sides and a key of each; no row is
    multiplied out, and a group of any size is two counts.
    """
    return loose.groupBy(*by).agg(
        F.sum(F.when(F.col("added"), 0).otherwise(1)).alias("n_before"), F.sum(F.when(F.col("added"), 1).otherwise(0)).alias("n_after"),
        F.max(F.when(~F.col("added"), F.col("key"))).alias("before_key"), F.max(F.when(F.col("added"), F.col("key"))).alias("after_key")) \
        .filter("n_before = 1 AND n_after = 1").drop("n_before", "n_after")


def diff_postings(
    prev: DataFrame, cur: DataFrame, cap: int | None = None, complete: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """Added, removed and updated postings of every board, as event rows.

    `complete` (resource_id, complete) says which boards were checked and whether their listing is whole;
    left out, it is read from `cur`. A checked board with no row in `cur` then counts as emptied. `unique` says
    that no key repeats within a listing, which merged pages guarantee. With a `cap`, only the first events of a
    board are kept.

    Digests meet first; whole rows are read a second time, for keys that differ only, and compared field by field.
    """
    touched = _touched(prev, cur, complete)
    m = touched.join(_rows(prev, touched, "before", unique), KEY, "left").join(_rows(cur, touched, "after", unique), KEY, "left")
    m = m.withColumn("changed_fields", tracked_changes(
        lambda f: F.col(f"before.{f}"), lambda f: F.col(f"after.{f}"), TRACKED_FIELDS))
    kind = (
        F.when(F.col("before").isNull(), JOB_ADDED)
        .when(F.col("after").isNull(), JOB_REMOVED)
        .when(F.size("changed_fields") > 0, JOB_UPDATED)
    )
    drafts = materialize(m.withColumn("type", kind).filter(F.col("type").isNotNull()), "drafts")

    # A posting known by no id gets a new key when a field changes: pair those, but only where it is certain.
    job = F.coalesce("after", "before")
    lc = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    loose = drafts.filter((F.col("type") != JOB_UPDATED) & (job["source"] == "jsonld")) \
        .select("resource_id", "key", (F.col("type") == JOB_ADDED).alias("added"), lc(job["title"]).alias("pair_title"), lc(job["company"]).alias("pair_company"))
    pairs = materialize(pair_unique(loose, ["resource_id", "pair_title", "pair_company"]).drop("pair_title", "pair_company"), "pairs")
    both = drafts.withColumn("paired", F.lit(False))
    if not pairs.isEmpty():
        sides = pairs.select("resource_id", F.explode(F.array(
            F.struct(F.lit(JOB_REMOVED).alias("type"), F.col("before_key").alias("key"), F.col("after_key").alias("pair")),
            F.struct(F.lit(JOB_ADDED).alias("type"), F.col("after_key").alias("key"), F.col("after_key").alias("pair")))).alias("p")).select("resource_id", "p.*")
        known = drafts.join(sides, ["resource_id", "key", "type"], "left")
        moved = known.filter("pair is not null").groupBy("resource_id", F.col("pair").alias("key")).agg(F.max("before").alias("before"), F.max("after").alias("after"))  # two rows each
        both = known.filter("pair is null").drop("pair").withColumn("paired", F.lit(False)).unionByName(moved.select(
            "resource_id", "key", F.lit(JOB_UPDATED).alias("type"), "before", "after",
            tracked_changes(lambda f: F.col(f"before.{f}"), lambda f: F.col(f"after.{f}"), TRACKED_FIELDS).alias("changed_fields"),
            F.lit(True).alias("complete"), F.lit(True).alias("paired")))

    enrichment = F.coalesce(F.col("before.partial"), F.lit(False)) & ~F.coalesce(F.col("after.partial"), F.lit(False))
    kept = both.filter(
        ~((F.col("type") == JOB_REMOVED) & ~F.col("complete"))
        & ~((F.col("type") == JOB_UPDATED) & enrichment))
    return cap_events(to_events(kept), cap)


def to_events(drafts: DataFrame) -> DataFrame:
    """Event rows: type, item key, summary, the posting before and after, and the text filters match."""
    job = F.coalesce("after", "before")
    rank = (
        F.when(F.col("type") == JOB_ADDED, 0).when(F.col("type") == JOB_REMOVED, 1)
        .when(~F.col("paired"), 2).otherwise(3)
    )
    position = F.when(F.col("type") != JOB_UPDATED, job["ordinal"]) \
        .when(F.col("paired"), F.col("before.ordinal")).otherwise(F.col("after.ordinal"))
    shown = drafts.select(
        "resource_id", "type", F.col("key").alias("item_key"), job.alias("job"),
        F.when(F.col("type") == JOB_UPDATED, F.col("before")).alias("before"),
        F.when(F.col("type") == JOB_UPDATED, F.col("changed_fields")).alias("changed_fields"),
        rank.alias("type_rank"), position.alias("position"))
    return shown.withColumns({
        "summary": event_summary(F.col("type"), F.col("job.title"), F.col("job.location"), F.col("changed_fields")),
        "search_text": search_text(*[F.col(f"job.{c}") for c in ("title", "location", "department", "company")]),
    })


def cap_events(events: DataFrame, n: int | None = None) -> DataFrame:
    """The first n events of a board per check: adds, removes, updates, then pairs, in listing order. All of them without n.

    Spark prunes each map task to n rows per board before the shuffle, so a huge board sends little.
    """
    if n is None:
        return events
    w = Window.partitionBy("resource_id").orderBy(*_in_board())
    return events.withColumn("event_no", F.row_number().over(w)).filter(F.col("event_no") <= n)


def _in_board() -> list[Column]:
    """The order of a board's events."""
    return [F.col("type_rank"), F.col("position").asc_nulls_last(), F.col("item_key")]


def assign_change_ids(events: DataFrame, start: int = 0) -> DataFrame:
    """Increasing ids after `start`, in order of check, board (hashed) and the event's place on it.

    The events are written, so that sampling reads their order alone and finds nothing anew; then range-partitioned
    and sorted by that order, so a board of any size spreads over many tasks, and written with each row's place in
    its partition; one count per partition gives the offsets.
    """
    events = materialize(events, "unnumbered")
    order = [*([F.col("round")] if "round" in events.columns else []), F.col("slot"), F.col("resource_id"), *_in_board()]
    slotted = events.withColumn("slot", F.substring(F.md5(F.col("resource_id").cast("binary")), 1, 3))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slotted.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("slot") \
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = materialize(placed, "events")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "_part") \
        .withColumn("change_id", (F.col("offset") + F.col("_at") + F.lit(start + 1)).cast("bigint")).drop("_part", "_at", "offset")
