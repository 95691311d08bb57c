"""A: sources and sinks; B18-B20; D18, H14: the same results from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import payloads as Y
from checks.q_extract import payloads
from checks.q_usage import OTHER_COUNTERS, ACCESS, LIMITS, _HITS
from checks.registry import query
from checks.shapes import postings
from jobdelta.operators import extract as X
from jobdelta.operators.usage import page_views
from jobdelta.plans.check import check_boards
from jobdelta.session import scratch_path
from jobdelta.sources import boards as B
from jobdelta.sources import payloads as P
from jobdelta.sources import sinks as K
from jobdelta.streaming.changes import read_changes, stream_changes
from jobdelta.streaming.usage import stream_counts_daily, stream_usage_daily, stream_window_limits

_COUNT = "SELECT concat('smartrecruiters', p_partkey // 50) AS resource_id, 0 AS page_no, count(*) AS jobs FROM part GROUP BY 1"


def _jobs(df):
    jobs = F.size(F.split("body", '"releasedDate"')) - 1
    return df.select("resource_id", "page_no", jobs.cast("bigint").alias("jobs"))


@query("a01_read_payloads", _COUNT)
def a01(i):
    path = scratch_path(i.spark, "a01")
    payloads(i, "smartrecruiters").write.json(path)
    return _jobs(P.read_payloads(i.spark, path, "json"))


@query("a02_stream_payloads", _COUNT)
def a02(i):
    path = scratch_path(i.spark, "a02")
    payloads(i, "smartrecruiters").repartition(4).write.parquet(f"{path}/in")
    stream = P.stream_payloads(i.spark, f"{path}/in", max_files=2)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp") \
        .trigger(availableNow=True).start().awaitTermination()
    return _jobs(i.spark.read.parquet(f"{path}/out"))


_LINES = """SELECT CASE s_suppkey % 5 WHEN 0 THEN concat('  https://jobs.lever.co/lev', s_suppkey, '  # team') WHEN 1 THEN '# only a comment' WHEN 2 THEN '   '
    WHEN 3 THEN concat('not a url ', s_suppkey) ELSE concat('HTTPS://boards.greenhouse.io/gh', s_suppkey) END AS value FROM supplier"""


@query("a03_read_board_list", """
SELECT CASE s_suppkey % 5 WHEN 0 THEN concat('https://jobs.lever.co/lev', s_suppkey) WHEN 3 THEN concat('not a url ', s_suppkey) ELSE concat('HTTPS://boards.greenhouse.io/gh', s_suppkey) END AS url,
       s_suppkey % 5 <> 3 AS valid FROM supplier WHERE s_suppkey % 5 IN (0, 3, 4)""")
def a03(i):
    path = scratch_path(i.spark, "a03")
    i.sql(_LINES).write.text(path)
    valid, invalid = B.read_board_list(i.spark, path)
    return valid.withColumn("valid", F.lit(True)).unionByName(invalid.withColumn("valid", F.lit(False)))


@query("a04_read_companies", "SELECT c_name AS name, concat('https://', c_custkey, '.example') AS website FROM customer WHERE c_custkey % 7 > 1")
def a04(i):
    path = scratch_path(i.spark, "a04")
    i.sql("""SELECT CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE c_name END AS name, concat('https://', c_custkey, '.example') AS website,
        c_custkey AS other FROM customer""").write.json(path)
    return B.read_companies(i.spark, path, multi_line=False)


@query("a05_write_snapshot", """
SELECT resource_id, key, title FROM fx_now WHERE resource_id NOT IN ('r3', 'r4')
UNION ALL SELECT resource_id, key, title FROM fx_prev WHERE resource_id = 'r3'
UNION ALL SELECT 'r1000', key, title FROM fx_prev WHERE resource_id = 'r5'""")
def a05(i):
    path = scratch_path(i.spark, "a05")
    now, prev = postings(i.fx_now), postings(i.fx_prev)
    K.write_snapshot(prev.filter("resource_id in ('r3', 'r4')"), path, buckets=16)
    K.write_snapshot(now.filter("resource_id <> 'r3' and resource_id <> 'r4'"), path, buckets=16)
    new = prev.filter("resource_id = 'r5'").withColumn("resource_id", F.lit("r1000"))
    gone = new.select("resource_id").limit(1).unionByName(i.spark.range(1).select(F.lit("r4").alias("resource_id")))
    K.write_snapshot(new, path, boards=gone, buckets=16)
    return K.read_snapshot(i.spark, path).select("resource_id", "key", "title")


@query("a06_write_changes", """
SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS detected_day, count(*) AS n, count(DISTINCT l_orderkey * 10 + l_linenumber) AS ids FROM lineitem GROUP BY 1""")
def a06(i):
    path = scratch_path(i.spark, "a06")
    rows = i.sql("SELECT l_orderkey * 10 + l_linenumber AS change_id, l_returnflag, l_shipdate FROM lineitem")
    for half in (rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag <> 'R'")):
        K.write_changes(half, path, F.date_trunc("year", "l_shipdate").cast("timestamp_ntz"))
    return i.spark.read.parquet(path).groupBy("detected_day").agg(F.count("*").alias("n"), F.count_distinct("change_id").alias("ids"))


@query("a07_write_board_list", """
SELECT max(b) AS board, CAST(arg_max(o_orderkey, b) % 9 AS INTEGER) AS jobs FROM (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('https://jobs.lever.co/L', o_custkey) ELSE concat('https://jobs.lever.co/l', o_custkey) END AS b, o_custkey * 0 + o_custkey AS o_orderkey FROM orders)
 GROUP BY lower(b)""")
def a07(i):
    path = scratch_path(i.spark, "a07")
    B.write_board_list(i.sql("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('https://jobs.lever.co/L', o_custkey) ELSE concat('https://jobs.lever.co/l', o_custkey) END AS board,
        CAST(o_custkey % 9 AS INT) AS jobs FROM orders"""), path)
    out = i.spark.read.schema("board string, jobs int").json(f"{path}/json")
    return out.join(i.spark.read.text(f"{path}/text").withColumnRenamed("value", "board"), "board", "left_semi")


_FETCHED = """SELECT o_orderkey AS id, concat('r', o_custkey) AS resource_id, CASE WHEN o_orderkey % 11 = 0 THEN 304 ELSE 200 END AS status,
   CASE WHEN o_orderkey % 3 = 0 THEN concat('e', o_custkey % 5) END AS etag, CASE WHEN o_orderkey % 3 < 2 THEN concat('d', o_orderkey % 4) END AS last_modified FROM orders"""
_ACCEPTED = """SELECT concat('r', c_custkey) AS resource_id, CASE WHEN c_custkey % 6 <> 0 THEN concat('s', c_custkey) END AS current_snapshot_id,
   concat('e', c_custkey % 3) AS etag, CASE WHEN c_custkey % 2 = 0 THEN concat('d', c_custkey % 4) END AS last_modified FROM customer"""


@query("a08_drop_not_modified", f"""
SELECT f.id FROM ({_FETCHED}) f LEFT JOIN ({_ACCEPTED}) b ON b.resource_id = f.resource_id AND b.current_snapshot_id IS NOT NULL
 WHERE f.status <> 304 AND NOT CASE WHEN f.etag IS NOT NULL AND b.etag IS NOT NULL THEN f.etag = b.etag
   WHEN f.last_modified IS NOT NULL AND b.last_modified IS NOT NULL THEN f.last_modified = b.last_modified ELSE false END""")
def a08(i):
    return P.drop_not_modified(i.sql(_FETCHED), i.sql(_ACCEPTED)).select("id")


# Every page given is read; a board is whole when nothing was refused and all that its total states is there.
@query("b18_merge_pages", """
SELECT concat('workday', p_partkey // 250) AS resource_id, CAST(count(*) AS BIGINT) AS total, count(*) AS jobs_count, false AS failed, true AS complete FROM part GROUP BY 1
UNION ALL SELECT concat('eightfold', p_partkey // 60), count(*), count(*) - CASE WHEN any_value(p_partkey // 60 % 3) = 1 THEN count(*) FILTER (p_partkey % 60 // 10 = 2) ELSE 0 END, false,
       NOT (any_value(p_partkey // 60 % 3) = 1 AND count(*) FILTER (p_partkey % 60 // 10 = 2) > 0) FROM part GROUP BY 1
UNION ALL SELECT concat('amazon', p_partkey // 350), CASE WHEN any_value(p_partkey // 350 % 2) = 1 THEN 0 ELSE count(*) END, CASE WHEN any_value(p_partkey // 350 % 2) = 1 THEN 0 ELSE count(*) END,
       any_value(p_partkey // 350 % 2) = 1, true FROM part GROUP BY 1""")
def b18(i):
    broken = F.when((F.col("adapter") == "amazon") & (F.regexp_extract("resource_id", "([0-9]+)$", 1).cast("int") % 2 == 1), F.lit('{"error":"x"}'))
    p = payloads(i, "workday").unionByName(payloads(i, "eightfold")).unionByName(payloads(i, "amazon"))
    p = p.withColumn("body", F.coalesce(broken, F.col("body")))
    _, boards = X.extract_postings(p, adapters=["workday", "eightfold", "amazon"])
    return boards.select("resource_id", "total", "jobs_count", "failed", "complete")


@query("b19_finalize", "SELECT resource_id, key, company, " + """
   regexp_matches(location, 'Remote') AS remote, 'mid' AS seniority FROM (""" + Y.EXPECTED["ashby"] + ")")
def b19(i):
    out, _ = X.extract_postings(payloads(i, "ashby"), adapters=["ashby"])
    return out.select("resource_id", "key", "company", "remote", "seniority")


@query("b20_other_content", """
SELECT concat('plain', page_id) AS resource_id, CAST(0 AS BIGINT) AS jobs_count, false AS failed FROM pages
UNION ALL SELECT concat('bad', page_id), 0, true FROM pages""")
def b20(i):
    p = i.sql("""SELECT concat('plain', page_id) AS resource_id, 'html' AS adapter, url AS fetch_url, 0 AS page_no, 200 AS status,
          CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' ELSE 'text/html' END AS content_type, html AS body FROM pages
        UNION ALL SELECT concat('bad', page_id), 'greenhouse', url, 0, 200, 'application/json', concat('{"jobs":[', html) FROM pages""")
    _, boards = X.extract_postings(p, adapters=["html", "greenhouse"])
    return boards.select("resource_id", "jobs_count", "failed")


# A board list checked twice: some parts leave, some come, some are renamed.
def _round(i, n):
    keep = "p_partkey % 7 <> 0" if n == 1 else "p_partkey % 10 <> 0" if n == 2 else "true"
    name = "p_name" if n == 1 else "CASE WHEN p_partkey % 13 = 0 THEN concat(p_name, ' II') ELSE p_name END"
    return i.sql(f"""SELECT concat('sm', p_partkey DIV 50) AS resource_id, 'check {n}' AS check_id, timestamp_seconds(1790000000 + {n} * 60) AS fetched_at, 'smartrecruiters' AS adapter, concat('https://api.smartrecruiters.com/v1/companies/Sm', p_partkey DIV 50, '/postings') AS fetch_url,
        0 AS page_no, 200 AS status, 'application/json' AS content_type,
        concat('{{"content":[', concat_ws(',', collect_list(to_json(named_struct('id', p_partkey, 'name', {name})))), ']}}') AS body FROM part WHERE {keep} GROUP BY p_partkey DIV 50""")


_ROUNDS = """SELECT concat('sm', p_partkey // 50) AS resource_id, concat('job:smartrecruiters:', p_partkey) AS item_key,
   CASE WHEN p_partkey % 7 = 0 THEN 'JOB_ADDED' WHEN p_partkey % 10 = 0 THEN 'JOB_REMOVED' ELSE 'JOB_UPDATED' END AS type FROM part
 WHERE (p_partkey % 7 = 0) <> (p_partkey % 10 = 0) OR (p_partkey % 7 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 13 = 0)"""


@query("d18b_check_boards", _ROUNDS)
def check(i):
    first, _ = X.extract_postings(_round(i, 1), adapters=["smartrecruiters"])
    path = scratch_path(i.spark, "d18b")
    K.write_snapshot(first, path, buckets=8)
    stored = K.read_snapshot(i.spark, path)
    return check_boards(_round(i, 2), stored, adapters=["smartrecruiters"]).changes.select("resource_id", "item_key", "type")


_THIRD = f"""{_ROUNDS} UNION ALL SELECT concat('sm', p_partkey // 50), concat('job:smartrecruiters:', p_partkey), 'JOB_ADDED' FROM part WHERE p_partkey % 10 = 0"""


def _land(i, n, path):
    """A round in up to 32 files, so that its payloads are read by as many tasks; three rounds stay within one trigger's 100 files."""
    _round(i, n).repartition(32, "resource_id").write.mode("append").parquet(path)


# All three rounds land in one trigger: each is compared with the one before it, as if they had come one by one.
@query("d18_stream_changes", _THIRD)
def d18(i):
    root = scratch_path(i.spark, "d18")
    for n in (3, 1, 2):
        _land(i, n, f"{root}/in")
    stream = P.stream_payloads(i.spark, f"{root}/in", max_files=100)
    stream_changes(stream, root, lambda b: X.extract_postings(b, adapters=["smartrecruiters"])).awaitTermination()
    return read_changes(i.spark, root).select("resource_id", "item_key", "type")


@query("d18c_stream_two_triggers", _THIRD)
def d18c(i):
    root = scratch_path(i.spark, "d18c")
    for rounds in ((1,), (2, 3)):
        for n in rounds:
            _land(i, n, f"{root}/in")
        stream = P.stream_payloads(i.spark, f"{root}/in", max_files=100)
        stream_changes(stream, root, lambda b: X.extract_postings(b, adapters=["smartrecruiters"])).awaitTermination()
    return read_changes(i.spark, root).select("resource_id", "item_key", "type")


def _streamed(i, df, build, name):
    """Feed a table to a stream in a few files, in time order, and return what the stream wrote."""
    root = scratch_path(i.spark, name)
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/in")
    stream = P.stream_payloads(i.spark, f"{root}/in", df.schema, max_files=100)

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")

    build(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/cp") \
        .trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(f"{root}/out").drop("batch")


@query("h14_stream_usage", "SELECT * FROM ox_usage")
def h14(i):
    return _streamed(i, i.fx_usage_events.drop("event_id"), stream_usage_daily, "h14")


@query("h14b_stream_counts", "SELECT * FROM ox_counts")
def h14b(i):
    return _streamed(i, page_views(i.sql(ACCESS)).unionByName(i.sql(OTHER_COUNTERS)), stream_counts_daily, "h14b")


@query("h14c_stream_window_limits", f"""
SELECT 'search' AS name, key, strftime(make_timestamp(CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) AS calls, count(*) > 2 AS over_limit FROM ({_HITS}) WHERE name = 'search' GROUP BY 2, 3""")
def h14c(i):
    s = LIMITS[0]
    out = _streamed(i, i.sql(_HITS), lambda e: stream_window_limits(e, s["name"], s["max"], s["window_seconds"]), "h14c")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
