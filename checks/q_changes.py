"""D: snapshots and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.shapes import changes, events, postings
from jobdelta.operators import changes as C
from jobdelta.operators import snapshot as S

SHOWN = ["resource_id", "type", "item_key", "summary", "search_text"]


@query("d02_dedupe_postings", """
SELECT resource_id, key, title, ordinal FROM (
  SELECT concat('r', l_suppkey % 400) AS resource_id, concat('part:', l_partkey) AS key,
         concat('Line ', l_orderkey, '-', l_linenumber) AS title, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY resource_id, key ORDER BY ordinal DESC) = 1""")
def d02(i):
    rows = i.sql("""SELECT concat('r', l_suppkey % 400) AS resource_id, concat('part:', l_partkey) AS key,
        concat('Line ', l_orderkey, '-', l_linenumber) AS title, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem""")
    return S.dedupe_postings(rows)


@query("d03_carry_forward", """
SELECT c.resource_id, c.key, CASE WHEN p.key IS NOT NULL THEN p.title ELSE c.title END AS title,
       CASE WHEN p.key IS NOT NULL THEN p.location ELSE c.location END AS location,
       (p.key IS NULL AND c.partial) AS partial
  FROM (SELECT resource_id, key, title, location, ordinal % 6 = 0 AS partial FROM fx_now) c
  LEFT JOIN (SELECT * FROM fx_prev WHERE NOT partial) p ON c.partial AND p.resource_id = c.resource_id AND p.key = c.key""")
def d03(i):
    cur = postings(i.fx_now).withColumn("partial", F.col("ordinal") % 6 == 0)
    return S.carry_forward(cur, postings(i.fx_prev)).select("resource_id", "key", "title", "location", "partial")


_HASHED = """WITH a AS (SELECT resource_id, string_agg(concat_ws('|', key, title, coalesce(location, '~')), ';' ORDER BY key) AS s,
                 count(*) AS n FROM fx_prev GROUP BY 1),
b AS (SELECT resource_id, string_agg(concat_ws('|', key, CASE WHEN ordinal % 57 = 0 THEN concat(title, '!') ELSE title END,
                 coalesce(location, '~')), ';' ORDER BY key) AS s FROM fx_prev GROUP BY 1)
"""


def _edited(i):
    prev = postings(i.fx_prev)
    return prev, prev.withColumn("title", F.when(F.col("ordinal") % 57 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))) \
        .withColumn("ordinal", -F.col("ordinal"))


@query("d04_content_hash", _HASHED + "SELECT a.resource_id, n AS jobs_count, a.s = b.s AS same FROM a JOIN b USING (resource_id)")
def d04(i):
    prev, edited = _edited(i)
    a = S.content_hash(prev)
    b = S.content_hash(edited).select("resource_id", F.col("content_hash").alias("other"))
    return a.join(b, "resource_id").select("resource_id", "jobs_count", (F.col("content_hash") == F.col("other")).alias("same"))


@query("d05_changed_boards", _HASHED + "SELECT a.resource_id FROM a JOIN b USING (resource_id) WHERE a.s <> b.s")
def d05(i):
    prev, edited = _edited(i)
    return S.changed_boards(edited, prev).select("resource_id")


@query("d06_baseline", """
SELECT n.resource_id, count(*) AS postings, n.resource_id IN (SELECT resource_id FROM fx_prev) AS has_previous,
       (SELECT count(*) FROM ox_events e WHERE e.resource_id = n.resource_id) AS events
  FROM fx_now n GROUP BY 1""")
def d06(i):
    per = events(i).groupBy("resource_id").agg(F.count("*").alias("events"))
    had = i.fx_prev.select("resource_id").distinct().withColumn("h", F.lit(True))
    return i.fx_now.groupBy("resource_id").agg(F.count("*").alias("postings")) \
        .join(had, "resource_id", "left").join(per, "resource_id", "left") \
        .select("resource_id", "postings", F.coalesce("h", F.lit(False)).alias("has_previous"),
                F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def _by_type(name, type_, fields=False):
    shown = ", array_to_string(changed_fields, ',') AS changed_fields" if fields else ""

    @query(name, f"SELECT resource_id, type, item_key, summary, search_text{shown} FROM ox_events WHERE type = '{type_}'")
    def run(i):
        extra = [F.array_join("changed_fields", ",").alias("changed_fields")] if fields else []
        return events(i).filter(F.col("type") == type_).select(*SHOWN, *extra)


_by_type("d07_diff_added", "JOB_ADDED")
_by_type("d08_diff_removed", "JOB_REMOVED")
_by_type("d09_diff_updated", "JOB_UPDATED", fields=True)


@query("d10_enrichment_is_silent", """
SELECT b.resource_id, count(*) AS enriched, count(e.item_key) AS reported FROM ox_both b
  LEFT JOIN ox_events e ON e.resource_id = b.resource_id AND e.item_key = b.key
 WHERE a_key IS NOT NULL AND b_key IS NOT NULL AND b_partial AND NOT a_partial GROUP BY 1""")
def d10(i):
    was = postings(i.fx_prev).filter("partial").select("resource_id", "key")
    now = postings(i.fx_now).filter("not partial").select("resource_id", "key")
    ev = events(i).select("resource_id", F.col("item_key").alias("key"), F.lit(1).alias("hit"))
    return was.join(now, ["resource_id", "key"]).join(ev, ["resource_id", "key"], "left") \
        .groupBy("resource_id").agg(F.count("*").alias("enriched"), F.count("hit").alias("reported"))


@query("d11_pair_unique", """
SELECT resource_id, b_key AS removed_key, a_key AS added_key, array_to_string(changed_fields, ',') AS changed_fields FROM ox_pairs WHERE NOT enriched""")
def d11(i):
    return events(i).filter((F.col("type") == "JOB_UPDATED") & (F.col("before.key") != F.col("job.key"))) \
        .select("resource_id", F.col("before.key").alias("removed_key"), F.col("job.key").alias("added_key"),
                F.array_join("changed_fields", ",").alias("changed_fields"))


@query("d12_cap_events", """
SELECT resource_id, item_key, event_no FROM (
  SELECT resource_id, item_key, row_number() OVER (PARTITION BY resource_id ORDER BY type_rank, position, item_key) AS event_no FROM ox_drafts)
 WHERE event_no <= 5""")
def d12(i):
    return C.diff_postings(postings(i.fx_prev), postings(i.fx_now), cap=5) \
        .select("resource_id", "item_key", F.col("event_no").cast("bigint").alias("event_no"))


@query("d13_events", """
SELECT e.resource_id, e.type, e.item_key, e.summary, e.search_text, e.title AS job_title,
       CASE WHEN e.type = 'JOB_UPDATED' THEN coalesce(p.title, q.title) END AS before_title
  FROM ox_events e LEFT JOIN fx_prev p ON p.resource_id = e.resource_id AND p.key = e.item_key
  LEFT JOIN (SELECT x.resource_id, x.a_key, y.title FROM ox_pairs x JOIN fx_prev y ON y.resource_id = x.resource_id AND y.key = x.b_key) q
    ON q.resource_id = e.resource_id AND q.a_key = e.item_key AND e.type_rank = 3""")
def d13(i):
    return events(i).select(*SHOWN, F.col("job.title").alias("job_title"), F.col("before.title").alias("before_title"))


@query("d14_assign_change_ids", "SELECT change_id + 1000 AS change_id, resource_id, type, item_key FROM ox_changes")
def d14(i):
    return C.assign_change_ids(events(i), start=1000).select("change_id", "resource_id", "type", "item_key")


_SNAPS = """SELECT concat('r', o_custkey % 200) AS resource_id, concat('s', o_orderkey) AS snapshot_id,
       o_orderdate AS fetched_at, CAST(floor(o_totalprice) AS BIGINT) AS jobs_count FROM orders"""


@query("d15_current_snapshot", f"""
SELECT resource_id, snapshot_id, jobs_count FROM ({_SNAPS})
QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, snapshot_id DESC) = 1""")
def d15(i):
    return S.current_snapshot(i.sql(_SNAPS)).select("resource_id", "snapshot_id", "jobs_count")


_DIFFS = """SELECT concat('r', o_custkey % 200) AS resource_id, concat('d', o_orderkey) AS diff_id,
       CASE WHEN o_orderkey % 5 <> 0 THEN concat('s', o_orderkey % 7) END AS base_snapshot_id FROM orders"""
_CURRENT = """SELECT concat('r', c_custkey) AS resource_id, CASE WHEN c_custkey % 3 <> 0 THEN concat('s', c_custkey % 7) END AS current_snapshot_id
       FROM customer"""


@query("d16_drop_stale", f"""
SELECT d.resource_id, diff_id, base_snapshot_id FROM ({_DIFFS}) d JOIN ({_CURRENT}) b
    ON d.resource_id = b.resource_id AND d.base_snapshot_id IS NOT DISTINCT FROM b.current_snapshot_id""")
def d16(i):
    return S.drop_stale(i.sql(_DIFFS), i.sql(_CURRENT)).select("resource_id", "diff_id", "base_snapshot_id")


@query("d17_open_postings", """
SELECT n.resource_id, n.key, n.title FROM fx_now n WHERE n.resource_id IN (
  SELECT b.resource_id FROM fx_boards b WHERE b.indexed OR b.resource_id IN (
    SELECT resource_id FROM fx_watches WHERE resource_id IS NOT NULL))""")
def d17(i):
    return S.open_postings(i.fx_boards, i.fx_watches, postings(i.fx_now)).select("resource_id", "key", "title")


@query("d14b_ids_follow_batches", """
SELECT resource_id, count(*) AS events, min(change_id) AS first_id, max(change_id) AS last_id FROM ox_changes GROUP BY 1""")
def d14b(i):
    return changes(i).groupBy("resource_id").agg(
        F.count("*").alias("events"), F.min("change_id").alias("first_id"), F.max("change_id").alias("last_id"))
