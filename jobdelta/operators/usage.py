"""Usage analytics over raw call and access logs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.functions.agents import agent_class
from jobdelta.functions.time import ago, day
from jobdelta.operators.numbering import numbered
from jobdelta.operators.snapshot import live
from jobdelta.session import materialize

# The public pages whose views are counted.
COUNTED_PAGES = ["/", "/jobs", "/signup", "/signin", "/docs", "/companies", "/llms.txt", "/privacy", "/terms", "/robots.txt"]
CLASSES = ["browser", "ai", "other"]


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def usage_daily(events: DataFrame) -> DataFrame:
    """Calls per UTC day, client, tool and interface."""
    return events.groupBy(F.to_date("ts").alias("day"), "client_id", "tool", "via").agg(F.count("*").alias("calls"))


def page_views(access_log: DataFrame, pages: list[str] | None = None) -> DataFrame:
    """Counter events of the counted pages: successful GETs, by path and kind of visitor."""
    path = F.split_part("url", F.lit("?"), F.lit(1))
    return access_log.filter((F.col("method") == "GET") & (F.col("status") == 200) & path.isin(pages or COUNTED_PAGES)) \
        .select("ts", F.lit("page_view").alias("metric"), F.concat_ws("|", path, agent_class(F.col("user_agent"))).alias("dim"))


def counts_daily(counter_events: DataFrame) -> DataFrame:
    """Counter events (ts, metric, dim) per day; whole dimensions, however long."""
    return counter_events.groupBy(F.to_date("ts").alias("day"), "metric", "dim") \
        .agg(F.count("*").alias("n"))


class ClientDays(NamedTuple):
    days: DataFrame     # day, bucket, clients (a bitmap), calls
    numbers: DataFrame  # client_id, number


def client_days(usage: DataFrame, known: DataFrame | None = None) -> ClientDays:
    """Who was active on each day, as bitmaps of client numbers, 32 768 clients a bucket.

    The usage rows are read once. Distinct clients of any span of days are then the bits of a union, and a day's
    bitmaps never change: a table of them grows by one day's. `known` (client_id, number) are the numbers given
    before; new clients get the next ones.
    """
    calls = materialize(usage.groupBy("day", "client_id").agg(F.sum("calls").alias("calls")), "client-calls")
    fresh = calls.filter(F.col("client_id").isNotNull()).select("client_id").distinct()
    if known is None:
        numbers = numbered(fresh, [F.col("client_id")], "number")
    else:
        start = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        numbers = known.select("client_id", "number").unionByName(numbered(fresh.join(known, "client_id", "left_anti"), [F.col("client_id")], "number", start))
    numbers = materialize(numbers, "client-numbers")
    days = calls.join(numbers, "client_id", "left").groupBy("day", F.bitmap_bucket_number("number").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("clients"), F.sum("calls").alias("calls"))
    return ClientDays(materialize(days, "client-days"), numbers)


def active_clients(days: DataFrame, spans: dict[str, Column]) -> DataFrame:
    """One row: the number of distinct clients over the days that each condition admits. A null client counts nowhere."""
    each = days.filter("bucket is not null").groupBy("bucket").agg(*[F.bitmap_or_agg(F.when(on, F.col("clients"))).alias(n) for n, on in spans.items()])
    return each.agg(*[_n(F.sum(F.bitmap_count(n))).alias(n) for n in spans])


def kpis(days: DataFrame, counts: DataFrame, clients: DataFrame, watches: DataFrame, today) -> DataFrame:
    """One row of headline numbers; `days` are the daily bitmaps of `client_days`."""
    t = day(today)
    active = active_clients(days, {"active_today": F.col("day") == t, "active_7d": F.col("day") > day(today, 7), "active_30d": F.col("day") > day(today, 30)})
    called = days.agg(_n(F.sum(F.when(F.col("day") == t, F.col("calls")))).alias("calls_today"))
    known = clients.agg(F.count("*").alias("clients_total"), F.count_if(F.to_date("created_at") == t).alias("new_today"))
    watching = live(watches).groupBy("client_id").agg(F.count("*").alias("n")) \
        .agg(F.count("*").alias("clients_with_watches"), _n(F.sum("n")).alias("live_watches"))
    anon = (F.col("metric") == "anonymous_search") & (F.col("day") == t)
    people = (F.col("metric") == "page_view") & F.col("dim").endswith("|browser") & (F.col("day") == t)
    counted = counts.agg(_n(F.sum(F.when(anon, F.col("n")))).alias("anon_calls_today"),
                         _n(F.sum(F.when(people, F.col("n")))).alias("people_views_today"))
    parts = [active, called, known, watching, counted]
    names = [c for p in parts for c in p.columns]
    # Each part is one row; stacking and folding them needs no join.
    rows = [p.select(*[F.col(c).cast("bigint").alias(c) if c in p.columns else F.lit(None).cast("bigint").alias(c) for c in names])
            for p in parts]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def calendar(df: DataFrame, today, days: int = 30) -> DataFrame:
    """The last `days` UTC days, oldest first."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.sequence(day(today, days - 1), day(today))).alias("day"))


def daily_series(days: DataFrame, counts: DataFrame, clients: DataFrame, today, n: int = 30) -> DataFrame:
    """A dense series of `n` days: active and new clients, calls, anonymous calls, and views by kind of visitor.

    `days` are the daily bitmaps of `client_days`.
    """
    recent = (F.col("day") > day(today, n)) & (F.col("day") <= day(today))
    used = days.filter(recent).groupBy("day").agg(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("clients"))).alias("active"), F.sum("calls").alias("calls"))
    new = clients.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("new"))
    is_view = F.col("metric") == "page_view"
    seen = counts.filter(recent).groupBy("day").agg(
        F.sum(F.when(F.col("metric") == "anonymous_search", F.col("n"))).alias("anon"),
        *[F.sum(F.when(is_view & F.col("dim").endswith(f"|{c}"), F.col("n"))).alias(c) for c in CLASSES])
    return calendar(days, today, n).join(used, "day", "left").join(new, "day", "left").join(seen, "day", "left") \
        .select("day", *[_n(F.col(c)).alias(c) for c in ("active", "new", "calls", "anon", *CLASSES)])


def tool_table(usage: DataFrame, counts: DataFrame, today) -> DataFrame:
    """Calls per tool and interface today, in 7 and in 30 days; calls without a token are listed apart."""
    def spans(value: str) -> list[Column]:
        return [
            _n(F.sum(F.when(F.col("day") == day(today), F.col(value)))).alias("today"),
            _n(F.sum(F.when(F.col("day") > day(today, 7), F.col(value)))).alias("d7"),
            _n(F.sum(value)).alias("d30"),
        ]

    recent = F.col("day") > day(today, 30)
    known = usage.filter(recent).groupBy("tool", "via").agg(*spans("calls"), F.count_distinct("client_id").alias("clients30")) \
        .withColumn("anonymous", F.lit(False))
    anon = counts.filter((F.col("metric") == "anonymous_search") & recent).groupBy("dim").agg(*spans("n")).select(
        F.split_part("dim", F.lit(":"), F.lit(2)).alias("tool"), F.split_part("dim", F.lit(":"), F.lit(1)).alias("via"),
        "today", "d7", "d30", F.lit(None).cast("bigint").alias("clients30"), F.lit(True).alias("anonymous"))
    return known.unionByName(anon).orderBy(F.col("d30").desc(), "tool", "anonymous")


def app_table(counts: DataFrame, today, top: int | None = None) -> DataFrame:
    """The apps that connect, most active first, in 7 and in 30 days; with `top` only so many."""
    table = counts.filter((F.col("metric") == "mcp_connect") & (F.col("day") > day(today, 30))).groupBy(F.col("dim").alias("client")) \
        .agg(_n(F.sum(F.when(F.col("day") > day(today, 7), F.col("n")))).alias("d7"), _n(F.sum("n")).alias("d30")) \
        .orderBy(F.col("d30").desc(), "client")
    return table if top is None else table.limit(top)


def source_table(clients: DataFrame, usage: DataFrame, today, now) -> DataFrame:
    """Where clients come from: new in 30 days and active in 7; sources with neither are left out."""
    active = usage.filter(F.col("day") > day(today, 7)).select("client_id").distinct().withColumn("active", F.lit(True))
    return clients.join(active, "client_id", "left").groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.count_if(F.col("created_at") > ago(now, days=30)).alias("new30"), F.count_if(F.col("active")).alias("active7"),
    ).filter("new30 > 0 OR active7 > 0").orderBy(F.col("active7").desc(), F.col("new30").desc(), "source")


def page_table(counts: DataFrame, today) -> DataFrame:
    """Page views of 7 days by kind of visitor, the most viewed first."""
    views = counts.filter((F.col("metric") == "page_view") & (F.col("day") > day(today, 7))).withColumns({
        "path": F.split_part("dim", F.lit("|"), F.lit(1)), "class": F.split_part("dim", F.lit("|"), F.lit(2))})
    wide = views.groupBy("path").pivot("class", CLASSES).agg(F.sum("n"))
    return wide.select("path", *[_n(F.col(c)).alias(c) for c in CLASSES]) \
        .orderBy((F.col("browser") + F.col("ai") + F.col("other")).desc(), "path")


def retention(clients: DataFrame, usage: ClientDays, today, now) -> DataFrame:
    """Clients of the last 30 days, before today, that used a tool; and how many used one on a later day.

    Per day of arrival the bitmap of its clients meets the union of all days' bitmaps and that of the later days'.
    """
    came = clients.filter((F.col("created_at") > ago(now, days=30)) & (F.to_date("created_at") < day(today))) \
        .join(usage.numbers, "client_id").groupBy(F.to_date("created_at").alias("came"), F.bitmap_bucket_number("number").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("cohort"))
    # Every day counts for the at most 31 days of arrival before it.
    last = F.least(F.date_sub("day", 1), day(today))
    later = usage.days.filter(F.col("bucket").isNotNull() & (last >= day(today, 31))) \
        .select("bucket", "clients", F.explode(F.sequence(day(today, 31), last)).alias("came")).groupBy("came", "bucket").agg(F.bitmap_or_agg("clients").alias("later"))
    sides = came.select("came", "bucket", F.col("cohort").alias("bits"), F.lit(True).alias("own")).unionByName(
        later.select("came", "bucket", F.col("later").alias("bits"), F.lit(False).alias("own")))
    met = sides.groupBy("came", "bucket").agg(F.max(F.when(F.col("own"), F.bitmap_count("bits"))).alias("n"), F.bitmap_and_agg("bits").alias("both"), F.count(F.lit(1)).alias("sides"))
    return met.agg(_n(F.sum("n")).alias("cohort"), _n(F.sum(F.when((F.col("sides") == 2) & F.col("n").isNotNull(), F.bitmap_count("both")))).alias("returned"))


def merge_identities(usage: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move the usage of merged clients (old_id, new_id) onto the client that adopted them."""
    return usage.join(mapping, usage["client_id"] == mapping["old_id"], "left").groupBy(
        "day", F.coalesce("new_id", "client_id").alias("client_id"), "tool", "via").agg(F.sum("calls").alias("calls"))


def window_limits(access_log: DataFrame, specs: list[dict]) -> DataFrame:
    """Calls per limit name, key and epoch-aligned window, and whether the limit was passed.

    `specs` is the short list of limits: name, max, window_seconds.
    """
    name = F.col("name")
    seconds = F.coalesce(*[F.when(name == s["name"], F.lit(s["window_seconds"])) for s in specs])
    top = F.coalesce(*[F.when(name == s["name"], F.lit(s["max"])) for s in specs])
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    start = F.timestamp_seconds(F.floor(epoch / seconds) * seconds).cast("timestamp_ntz")
    return access_log.withColumn("top", top).filter("top is not null") \
        .groupBy("name", "key", "top", start.alias("window_start")).agg(F.count("*").alias("calls")) \
        .select("name", "key", "window_start", "calls", (F.col("calls") > F.col("top")).alias("over_limit"))


def clients_by_source(clients: DataFrame, now, days: int = 7) -> DataFrame:
    return clients.filter(F.col("created_at") > ago(now, days=days)) \
        .groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


def source_tag(c: Column) -> Column:
    """A usable reference tag in lower case, NULL otherwise."""
    return F.when(F.rlike(c, F.lit("^(?i)[a-z0-9][a-z0-9._-]{0,39}$")), F.lower(c))


def attribute_sources(clients: DataFrame, connects: DataFrame) -> DataFrame:
    """Clients known only as `oauth` take the first usable tag seen on a later connection (client_id, ts, ref)."""
    tags = connects.withColumn("tag", source_tag(F.col("ref"))).filter("tag is not null") \
        .groupBy("client_id").agg(F.min_by("tag", F.struct("ts", "tag")).alias("tag"))
    return clients.join(tags, "client_id", "left").withColumn(
        "source", F.when((F.col("source") == "oauth") & F.col("tag").isNotNull(), F.col("tag")).otherwise(F.col("source"))).drop("tag")
