"""Robots rules of many sites applied to many URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobdelta.functions.urls import origin_of, path_of


def _pattern(rule: Column) -> Column:
    """A rule as a regex from the start of the path: `*` is anything, a final `$` anchors the end."""
    body = F.regexp_replace(F.regexp_replace(rule, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(rule.endswith("$"), F.lit("$")).otherwise(F.lit("")))


def robots_rules(bodies: DataFrame, agent: str) -> DataFrame:
    """The rules that bind `agent` on each origin: (origin, rules array).

    A group that names the agent beats the `*` group. The array is as long as one robots file.
    """
    lines = bodies.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "raw")) \
        .withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter(F.col("line").contains(":")) \
        .select("origin", "line_no", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"),
                F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    in_file = Window.partitionBy("origin").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("field").over(in_file), F.lit("")) != "user-agent")
    grouped = lines.withColumn("group", F.sum(starts.cast("int")).over(in_file)).filter("group > 0")
    named = F.lit(agent.lower())
    groups = grouped.groupBy("origin", "group").agg(
        F.bool_or(is_agent & (F.col("value") != "*") & F.contains(named, F.lower("value"))).alias("specific"),
        F.bool_or(is_agent & (F.col("value") == "*")).alias("star"),
        F.collect_list(F.when(F.col("field").isin("allow", "disallow") & (F.col("value") != ""), F.struct(
            F.length("value").alias("length"), (F.col("field") == "allow").alias("allow"), _pattern(F.col("value")).alias("regex")))).alias("rules"))
    return groups.groupBy("origin").agg(
        F.bool_or("specific").alias("named"),
        F.flatten(F.collect_list(F.when(F.col("specific"), F.col("rules")))).alias("own"),
        F.flatten(F.collect_list(F.when(F.col("star"), F.col("rules")))).alias("any"),
    ).select("origin", F.when(F.col("named"), F.col("own")).otherwise(F.col("any")).alias("rules"))


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """`urls` with an `allowed` flag, from robots files (origin, status, body).

    The longest matching rule decides, a tie allows. A server error refuses all, a missing file allows all.
    Rules ride along as one short array per origin, so URLs and rules are never paired up as rows.
    """
    ok = robots.filter((F.col("status") >= 200) & (F.col("status") < 300))
    sites = robots.select("origin", (F.col("status") >= 500).alias("closed")) \
        .join(robots_rules(ok, agent), "origin", "left")
    c = F.col(url)
    path = F.concat(path_of(c), F.regexp_extract(c, r"^[^?#]*(\?[^#]*)", 1))
    joined = urls.withColumns({"origin": origin_of(c), "path": path}).join(sites, "origin", "left")
    hits = F.filter("rules", lambda r: F.rlike(F.col("path"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"], r["allow"])))
    allowed = F.when(F.coalesce("closed", F.lit(False)), False).otherwise(F.coalesce(best["allow"], F.lit(True)))
    return joined.withColumn("allowed", allowed).select(*urls.columns, "allowed")
