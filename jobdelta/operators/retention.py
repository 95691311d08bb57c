"""What is kept and what goes: every rule splits a table into its kept and deleted rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.functions.time import ago, at, day
from jobdelta.operators.snapshot import live


class Split(NamedTuple):
    kept: DataFrame
    deleted: DataFrame


def _split(df: DataFrame, gone: Column) -> Split:
    gone = F.coalesce(gone, F.lit(False))
    return Split(df.filter(~gone), df.filter(gone))


def _flag(df: DataFrame, other: DataFrame, on: str | list[str], name: str) -> DataFrame:
    """Whether a row has a partner in `other`."""
    keys = [on] if isinstance(on, str) else on
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left") \
        .withColumn(name, F.coalesce(name, F.lit(False)))


def expire_watches(watches: DataFrame, now, ttl_days: int = 30) -> DataFrame:
    """Watches with `deleted_at` and `delete_reason` set where nobody read them for the TTL."""
    stale = F.col("deleted_at").isNull() & (F.col("last_accessed_at") < ago(now, days=ttl_days))
    return watches.withColumns({
        "delete_reason": F.when(stale, "expired").otherwise(F.col("delete_reason")),
        "deleted_at": F.when(stale, at(now)).otherwise(F.col("deleted_at"))})


def drop_changes(changes: DataFrame, now, days: int = 90) -> Split:
    """Changes past retention; on a table partitioned by `detected_day` only whole days are read."""
    return _split(changes, F.col("detected_at") < ago(now, days=days))


def drop_snapshots(snapshots: DataFrame, boards: DataFrame, now, days: int = 30) -> Split:
    """Old snapshots that are no board's current one."""
    marked = _flag(snapshots, boards.select(F.col("current_snapshot_id").alias("snapshot_id")), "snapshot_id", "is_current")
    s = _split(marked, (F.col("fetched_at") < ago(now, days=days)) & ~F.col("is_current"))
    return Split(s.kept.drop("is_current"), s.deleted.drop("is_current"))


def drop_deleted_watches(watches: DataFrame, now, days: int = 30) -> Split:
    return _split(watches, F.col("deleted_at") < ago(now, days=days))


def drop_boards(boards: DataFrame, watches: DataFrame, now) -> Split:
    """Boards older than a day, outside the directory, that no watch row mentions."""
    marked = _flag(boards, watches.filter("resource_id is not null"), "resource_id", "is_watched")
    s = _split(marked, (F.col("created_at") < ago(now, days=1)) & ~F.coalesce("indexed", F.lit(False)) & ~F.col("is_watched"))
    return Split(s.kept.drop("is_watched"), s.deleted.drop("is_watched"))


def drop_idle_clients(clients: DataFrame, watches: DataFrame, now, days: int = 90) -> Split:
    """Clients not seen for 90 days that have no live watch."""
    marked = _flag(clients, live(watches), "client_id", "is_watching")
    s = _split(marked, (F.col("last_seen_at") < ago(now, days=days)) & ~F.col("is_watching"))
    return Split(s.kept.drop("is_watching"), s.deleted.drop("is_watching"))


def drop_unshown_clients(clients: DataFrame, tokens: DataFrame, watches: DataFrame, now) -> Split:
    """Clients nobody holds a token for: never shown one, older than an hour, no token and no watch."""
    marked = _flag(_flag(clients, tokens, "client_id", "has_token"), watches, "client_id", "has_watch")
    s = _split(marked, ~F.col("token_shown") & (F.col("created_at") < ago(now, hours=1)) & ~F.col("has_token") & ~F.col("has_watch"))
    return Split(s.kept.drop("has_token", "has_watch"), s.deleted.drop("has_token", "has_watch"))


def drop_old_days(daily: DataFrame, today, days: int = 400) -> Split:
    """Usage or counter rows older than 400 days."""
    return _split(daily, F.col("day") < day(today, days))


def drop_windows(windows: DataFrame, now) -> Split:
    return _split(windows, F.col("window_start") < ago(now, days=1))


def drop_finished_outbox(outbox: DataFrame, now, days: int = 7) -> Split:
    return _split(outbox, (F.col("status") != "pending") & (F.col("created_at") < ago(now, days=days)))


def drop_leases(leases: DataFrame, now) -> Split:
    return _split(leases, F.col("leased_until") < ago(now, hours=1))


def delete_accounts(
    user_ids: DataFrame, users: DataFrame, clients: DataFrame, watches: DataFrame, outbox: DataFrame
) -> dict[str, DataFrame]:
    """Everything left after removing accounts: their users, clients, watches and outbox rows go."""
    gone_users = users.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    gone_clients = gone_users.filter("client_id is not null").select("client_id").distinct()
    gone_watches = watches.join(gone_clients, "client_id", "left_semi").select("watch_id")
    return {
        "users": users.join(gone_users.select("user_id"), "user_id", "left_anti"),
        "clients": clients.join(gone_clients, "client_id", "left_anti"),
        "watches": watches.join(gone_clients, "client_id", "left_anti"),
        "outbox": outbox.join(gone_watches, "watch_id", "left_anti"),
    }


def report(**splits: Split) -> DataFrame:
    """Rows kept and deleted per rule."""
    parts = [
        s.deleted.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("rule"), "deleted", F.lit(0).cast("bigint").alias("kept"))
        .unionByName(s.kept.agg(F.count("*").alias("kept")).select(F.lit(name).alias("rule"), F.lit(0).cast("bigint").alias("deleted"), "kept"))
        for name, s in splits.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule").agg(F.sum("deleted").alias("deleted"), F.sum("kept").alias("kept"))
