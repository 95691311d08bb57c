"""Checks of many boards: payloads in, change events and the next snapshot out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobdelta.operators.changes import assign_change_ids, diff_postings
from jobdelta.operators.extract import CHECK, extract_postings
from jobdelta.operators.percolate import percolate
from jobdelta.operators.snapshot import KEY, content_hash
from jobdelta.session import materialize
from jobdelta.sources.payloads import drop_not_modified


class Check(NamedTuple):
    changes: DataFrame      # events with ids, each with the check that found it
    postings: DataFrame     # the last listing of every board, details learned earlier carried over
    boards: DataFrame       # every check of the batch: totals, completeness, whether it failed
    hashes: DataFrame       # content hash of every board whose listing was read


def _listing(resource_id: Column, turn: Column) -> Column:
    """One listing of a board as a board of its own: its turn, a colon, the board."""
    return F.concat(turn.cast("string"), F.lit(":"), resource_id)


def _carried(listings: DataFrame, fields: list[str]) -> DataFrame:
    """Partial rows replaced by the last full row of their key, where the key was listed in every check since then.

    One window over (board, key) in the order of checks serves all of them; `turn` 0 is the stored listing. Position
    and `complete` stay those of the row.
    """
    own = Window.partitionBy(*KEY).orderBy("turn")
    partial = F.coalesce("partial", F.lit(False))
    full = F.when(~partial, F.struct("turn", *fields))
    starts = F.when(F.coalesce(F.lag("turn").over(own), F.lit(-1)) != F.col("turn") - 1, F.col("turn"))
    seen = listings.withColumns({"_full": F.last(full, ignorenulls=True).over(own), "_start": starts}) \
        .withColumn("_start", F.last("_start", ignorenulls=True).over(own))
    swap = partial & (F.col("_full.turn") >= F.col("_start"))
    return seen.select(*[F.when(swap, F.col(f"_full.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in listings.columns])


def compare_checks(postings: DataFrame, boards: DataFrame, previous: DataFrame, start_id: int = 0, hashes: DataFrame | None = None) -> Check:
    """The checks of a batch in the order in which they were fetched, each against the listing before it.

    All checks of all boards are compared in one pass: a listing is a board of its own, met once as the new one and
    once as the one before the next check, so the number of jobs does not follow the checks per board. Listings
    whose posting set equals the one before drop out by their hash. A failed check changes nothing. `hashes`
    (resource_id, content_hash) are the stored ones of `previous`; without them its postings are hashed anew.
    """
    turn = F.row_number().over(Window.partitionBy("resource_id").orderBy(F.col("fetched_at").asc_nulls_first(), "check_id"))
    ok = materialize(boards.filter(~F.col("failed")).withColumn("turn", turn), "checks")
    checked = ok.groupBy("resource_id").agg(F.max("turn").alias("last"))
    stored = previous.drop("check_id").join(checked.select("resource_id"), "resource_id", "left_semi").withColumn("turn", F.lit(0))
    new = postings.join(ok.select(*CHECK, "turn"), CHECK).drop("check_id")
    fields = [c for c in new.columns if c not in (*KEY, "ordinal", "complete", "turn") and c in stored.columns]
    whole = materialize(_carried(new.unionByName(stored, allowMissingColumns=True).select(*new.columns), fields), "current")

    told = whole if hashes is None else whole.filter("turn > 0")
    now = content_hash(told.withColumn("resource_id", _listing(F.col("resource_id"), F.col("turn"))).drop("turn")).select("resource_id", "content_hash")
    if hashes is not None:
        now = now.unionByName(hashes.join(checked.select("resource_id"), "resource_id", "left_semi").select(_listing(F.col("resource_id"), F.lit(0)).alias("resource_id"), "content_hash"))
    now = materialize(now, "hashes")
    at = ok.withColumns({"listing": _listing(F.col("resource_id"), F.col("turn")), "before": _listing(F.col("resource_id"), F.col("turn") - 1)})
    mine = now.select(F.col("resource_id").alias("listing"), F.col("content_hash").alias("own"))
    other = now.select(F.col("resource_id").alias("before"), F.col("content_hash").alias("old"))
    # An emptied listing has no hash; it is compared unless the one before was empty too.
    todo = materialize(at.join(mine, "listing", "left").join(other, "before", "left").filter("old is not null and not (own <=> old)")
                       .select(*CHECK, "turn", "listing", "fetched_at", "complete"), "compared")

    def side(shift: int) -> DataFrame:
        met = todo.select("resource_id", (F.col("turn") - shift).alias("turn"), "listing")
        return whole.join(met, ["resource_id", "turn"]).drop("resource_id", "turn").withColumnRenamed("listing", "resource_id")

    events = diff_postings(side(1), side(0), complete=todo.select(F.col("listing").alias("resource_id"), "complete"), unique=True)
    events = events.withColumnRenamed("resource_id", "listing") \
        .join(todo.select(*CHECK, F.col("turn").alias("round"), "listing", F.col("fetched_at").alias("detected_at")), "listing").drop("listing")
    latest = whole.join(checked.select("resource_id", F.col("last").alias("turn")), ["resource_id", "turn"], "left_semi").drop("turn")
    last = checked.select(_listing(F.col("resource_id"), F.col("last")).alias("listing"), F.col("resource_id").alias("board"))
    found = now.join(last, now["resource_id"] == last["listing"]).select(F.col("board").alias("resource_id"), "content_hash")
    return Check(assign_change_ids(events, start_id).drop("round"), latest, boards, found)


def check_boards(payloads: DataFrame, previous: DataFrame, companies: DataFrame | None = None, start_id: int = 0,
                 adapters: list[str] | None = None, accepted: DataFrame | None = None, hashes: DataFrame | None = None) -> Check:
    """Payloads to change events: extract, merge pages, carry forward, skip unchanged boards, diff, number.

    `accepted` (resource_id, current_snapshot_id, etag, last_modified) leaves out payloads that did not change;
    `hashes` (resource_id, content_hash) spares hashing the stored postings again.
    """
    if accepted is not None:
        payloads = drop_not_modified(payloads, accepted)
    postings, boards = extract_postings(payloads, companies, adapters)
    return compare_checks(postings, boards, previous, start_id, hashes)


def deliver(changes: DataFrame, watches: DataFrame) -> DataFrame:
    """Which saved searches see which changes."""
    return percolate(changes, watches, carry=["change_id", "resource_id", "type", "item_key", "summary"])
