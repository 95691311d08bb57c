"""Health of the checks: counters, histograms, gauges and alert conditions over the check log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.functions.time import ago
from jobdelta.operators.snapshot import live

# Upper bounds of the duration buckets, in seconds.
BUCKETS = [0.1, 0.25, 0.5, 1, 2.5, 5, 10, 20]
REFUSALS = ["BOT_CHALLENGE", "ACCESS_DENIED", "RATE_LIMITED"]


def check_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome", "code").agg(F.count("*").alias("n"))


def _le(b: float) -> str:
    return f"{b:g}"


def duration_histogram(log: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Cumulative duration buckets, with +Inf, as (le, n); one pass with partial counts."""
    x = F.col(seconds)
    counts = log.agg(*[F.count_if(x <= b).alias(_le(b)) for b in BUCKETS], F.count(x).alias("+Inf"))
    names = [_le(b) for b in BUCKETS] + ["+Inf"]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in names])))


def duration_totals(log: DataFrame, seconds: str = "seconds") -> DataFrame:
    return log.agg(F.sum(seconds).alias("sum"), F.count(seconds).alias("count"))


def cap_series(df: DataFrame, n: int, label: str = "label", order: str = "ts") -> DataFrame:
    """Counts per label where only the first n labels to appear keep their name; the rest are `other`."""
    first = df.groupBy(label).agg(F.min(F.struct(order)).alias("first"))
    kept = first.orderBy("first", label).limit(n).select(label, F.lit(True).alias("kept"))
    counts = df.groupBy(label).agg(F.count("*").alias("n")).join(kept, label, "left")
    return counts.groupBy(F.when(F.col("kept"), F.col(label)).otherwise("other").alias(label)).agg(F.sum("n").alias("n"))


def health(boards: DataFrame, watches: DataFrame, outbox: DataFrame, now) -> DataFrame:
    """Gauges as (gauge, value) rows."""
    alive = live(watches)
    per_board = alive.filter("resource_id is not null").groupBy("resource_id").agg(F.count("*").alias("n"))
    listed = F.coalesce("indexed", F.lit(False))
    refused = F.lit(False)
    for code in REFUSALS:
        refused = refused | F.coalesce(F.col("last_error").startswith(code), F.lit(False))
    parts = [
        alive.agg(F.count("*").alias("watches"), F.count_if(F.col("resource_id").isNull()).alias("search_watches")),
        per_board.agg(F.count("*").alias("watched_boards")),
        boards.agg(
            F.count_if(listed).alias("directory"),
            F.count_if(listed & (F.col("consecutive_failures") == 0) & (F.col("next_check_at") < ago(now, hours=1))).alias("overdue"),
            F.count_if(F.col("consecutive_failures") > 0).alias("failing"),
            F.count_if((F.col("last_checked_at") > ago(now, hours=1)) & refused).alias("blocked")),
        outbox.agg(F.count_if(F.col("status") == "pending").alias("outbox_pending")),
    ]
    rows = [p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("gauge"), F.col(c).alias("value")) for c in p.columns]))) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _quantile(q: float) -> Column:
    """The q-quantile read off cumulative buckets, interpolated inside the bucket it falls in."""
    rank = F.col("timed") * q
    lower, value = 0.0, None
    below = F.lit(0)
    for b in BUCKETS:
        n = F.col(f"`b{_le(b)}`")
        inside = F.lit(lower) + F.lit(b - lower) * F.try_divide(rank - below, n - below)
        value = F.when(n >= rank, inside) if value is None else value.when(n >= rank, inside)
        lower, below = float(b), n
    return F.when(F.col("timed") > 0, value.otherwise(F.lit(float(BUCKETS[-1]))))


def check_windows(log: DataFrame, length: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Checks, error ratio and p95 duration per sliding window, by the time the window ends."""
    secs = F.col("seconds")
    per = log.groupBy(F.window("checked_at", length, slide).alias("w")).agg(
        F.count("*").alias("checks"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count(secs).alias("timed"),
        *[F.count_if(secs <= b).alias(f"b{_le(b)}") for b in BUCKETS])
    return per.select(F.col("w.end").alias("ends_at"), "checks", "errors",
                      (F.col("errors") / F.col("checks")).alias("error_ratio"), _quantile(0.95).alias("p95"))


def log_alerts(log: DataFrame) -> DataFrame:
    """When each condition on the check log held without a gap: errors over a quarter for 30 minutes, p95 over
    10 s for 30 minutes, no check in 30 minutes for 15 more.

    Conditions are read every 5 minutes; holding is a count over a second window, so time is never
    sorted in one task.
    """
    step = 300
    marks = check_windows(log).select("ends_at", F.explode(F.array(
        F.struct(F.lit("errors_high").alias("alert"), (F.col("error_ratio") > 0.25).alias("bad")),
        F.struct(F.lit("slow").alias("alert"), (F.col("p95") > 10).alias("bad")))).alias("m")) \
        .filter("m.bad").select("ends_at", "m.alert")
    # A window that saw no check has no row: list every 5 minutes between the first and the last check.
    seen = log.agg(F.min("checked_at").alias("a"), F.max("checked_at").alias("b"))
    floor = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / step) * step).cast("timestamp_ntz")
    ticks = seen.filter("a is not null").select(F.explode(F.sequence(
        floor("a") + F.expr("interval 30 minutes"), floor("b"), F.expr("interval 5 minutes"))).alias("ends_at"))
    busy = check_windows(log, "30 minutes").select("ends_at")
    stalled = ticks.join(busy, "ends_at", "left_anti").select("ends_at", F.lit("stalled").alias("alert"))

    def held(df: DataFrame, evaluations: int) -> DataFrame:
        """Instants whose last `evaluations` readings, 5 minutes apart, were all bad."""
        after = F.explode(F.transform(F.sequence(F.lit(0), F.lit(evaluations - 1)),
                                      lambda k: F.col("ends_at") + F.make_dt_interval(F.lit(0), F.lit(0), k * 5)))
        return df.select("alert", after.alias("ends_at")).groupBy("alert", "ends_at").agg(F.count("*").alias("n")) \
            .filter(F.col("n") == evaluations).select("alert", "ends_at")

    return held(marks, 7).unionByName(held(stalled, 4))


def gauge_alerts(gauges: DataFrame, log: DataFrame, now) -> DataFrame:
    """Conditions on the current gauges: refused boards, outbox backlog, overdue directory, nothing checked."""
    # The thresholds.
    limits = {"blocked": 10, "outbox_pending": 500, "overdue": 100}
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    over = gauges.filter(F.col("gauge").isin(list(limits))).select(
        F.col("gauge").alias("alert"), "value", (F.col("value") > F.try_element_at(limit, F.col("gauge"))).alias("firing"))
    recent = log.filter(F.col("checked_at") > ago(now, minutes=30)).agg(F.count("*").alias("n"))
    idle = gauges.filter(F.col("gauge") == "watched_boards").select(
        F.lit("stalled").alias("alert"), "value", ((F.col("value") > 0) & (recent.scalar() == 0)).alias("firing"))
    return over.unionByName(idle)
