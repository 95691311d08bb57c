"""H: usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import ORACLE_VIEWS
from jobdelta.functions.agents import agent_class, with_client_bucket
from jobdelta.functions.sql import register_functions
from jobdelta.operators import usage as U

TODAY, NOW = "2024-01-08", "2024-01-08 18:00:00"

ORACLE_VIEWS["ox_usage"] = """
SELECT CAST(ts AS DATE) AS day, client_id, tool, via, count(*) AS calls FROM fx_usage_events WHERE user_id_ok GROUP BY ALL""".replace(" WHERE user_id_ok", "")

# Requests as an access log.
ACCESS = """SELECT ts, CASE WHEN event_id % 9 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status,
  CASE event_id % 6 WHEN 0 THEN '/?ref=x' WHEN 1 THEN '/jobs' WHEN 2 THEN '/docs?a=1' WHEN 3 THEN '/private' WHEN 4 THEN '/robots.txt' ELSE '/companies' END AS url,
  CASE user_id % 5 WHEN 0 THEN 'Mozilla/5.0 (X11; Linux) Firefox/140.0' WHEN 1 THEN 'Mozilla/5.0 (compatible; GPTBot/1.1)'
       WHEN 2 THEN 'curl/8.1' WHEN 3 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' END AS user_agent FROM events"""
_CLASS = "CASE user_id % 5 WHEN 0 THEN 'browser' WHEN 1 THEN 'ai' ELSE 'other' END"
ORACLE_VIEWS["ox_counter_events"] = f"""
SELECT ts, 'page_view' AS metric, concat(CASE event_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '/jobs' WHEN 2 THEN '/docs' WHEN 4 THEN '/robots.txt' ELSE '/companies' END, '|', {_CLASS}) AS dim
  FROM events WHERE event_id % 9 <> 0 AND event_id % 7 <> 0 AND event_id % 6 <> 3
UNION ALL SELECT ts, 'anonymous_search', concat(CASE WHEN event_id % 2 = 0 THEN 'rest' ELSE 'mcp' END, ':', event_type) FROM events WHERE event_id % 4 = 0
UNION ALL SELECT ts, 'mcp_connect', concat(repeat('long-name-', 13), user_id) FROM events WHERE event_id % 3 = 0 AND user_id % 50 = 0
UNION ALL SELECT ts, 'mcp_connect', concat('app-', user_id % 31) FROM events WHERE event_id % 3 = 0"""
ORACLE_VIEWS["ox_counts"] = """
SELECT CAST(ts AS DATE) AS day, metric, dim, count(*) AS n FROM ox_counter_events GROUP BY ALL"""

OTHER_COUNTERS = """SELECT ts, 'anonymous_search' AS metric, concat(CASE WHEN event_id % 2 = 0 THEN 'rest' ELSE 'mcp' END, ':', event_type) AS dim FROM events WHERE event_id % 4 = 0
UNION ALL SELECT ts, 'mcp_connect', concat(repeat('long-name-', 13), user_id) FROM events WHERE event_id % 3 = 0 AND user_id % 50 = 0
UNION ALL SELECT ts, 'mcp_connect', concat('app-', user_id % 31) FROM events WHERE event_id % 3 = 0"""


def usage(i):
    return U.usage_daily(i.fx_usage_events)


def counts(i):
    return U.counts_daily(U.page_views(i.sql(ACCESS)).unionByName(i.sql(OTHER_COUNTERS)))


@query("h01_usage_daily", "SELECT * FROM ox_usage")
def h01(i):
    return usage(i)


@query("h02_counts_daily", "SELECT * FROM ox_counts")
def h02(i):
    return counts(i)


@query("c17_agent_class", f"""
SELECT event_id, {_CLASS} AS class FROM events""")
def c17(i):
    log = i.sql(ACCESS.replace("SELECT ts,", "SELECT event_id, ts,"))
    return log.select("event_id", agent_class(F.col("user_agent")).alias("class"))


_IPS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('10.0.', user_id % 250, '.', event_id % 250)
    WHEN 1 THEN concat('::ffff:10.1.', user_id % 250, '.7')
    WHEN 2 THEN concat('2001:db8:0:', user_id % 100, '::', event_id % 90)
    ELSE concat('2001:0db8:00ab:', lpad(CAST(user_id % 100 AS STRING), 4, '0'), ':1:2:3:', event_id % 90) END AS ip FROM events"""


_BUCKETS = f"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN ip WHEN 1 THEN concat('10.1.', user_id % 250, '.7')
    WHEN 2 THEN concat('2001:db8:0:', user_id % 100, '::/64') ELSE concat('2001:db8:ab:', user_id % 100, '::/64') END AS bucket
  FROM ({_IPS}) JOIN events USING (event_id)"""


@query("c18_client_bucket", _BUCKETS)
def c18(i):
    return with_client_bucket(i.sql(_IPS)).select("event_id", "bucket")


@query("k03_sql_client_bucket", _BUCKETS)
def k03(i):
    register_functions(i.spark)
    return i.sql(_IPS).select("event_id", F.expr("client_bucket(ip)").alias("bucket"))


@query("h03_kpis", f"""
SELECT (SELECT count(DISTINCT client_id) FROM ox_usage WHERE day = DATE '{TODAY}') AS active_today,
       (SELECT count(DISTINCT client_id) FROM ox_usage WHERE day > DATE '{TODAY}' - 7) AS active_7d,
       (SELECT count(DISTINCT client_id) FROM ox_usage WHERE day > DATE '{TODAY}' - 30) AS active_30d,
       (SELECT CAST(coalesce(sum(calls), 0) AS BIGINT) FROM ox_usage WHERE day = DATE '{TODAY}') AS calls_today,
       (SELECT count(*) FROM fx_clients) AS clients_total,
       (SELECT count(*) FROM fx_clients WHERE CAST(created_at AS DATE) = DATE '{TODAY}') AS new_today,
       (SELECT count(DISTINCT client_id) FROM fx_watches) AS clients_with_watches, (SELECT count(*) FROM fx_watches) AS live_watches,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ox_counts WHERE day = DATE '{TODAY}' AND metric = 'anonymous_search') AS anon_calls_today,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ox_counts WHERE day = DATE '{TODAY}' AND metric = 'page_view' AND dim LIKE '%|browser') AS people_views_today""")
def h03(i):
    return U.kpis(U.client_days(usage(i)).days, counts(i), i.fx_clients, i.fx_watches, TODAY)


_VIEWS = ", ".join(
    f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ox_counts v WHERE v.day = d.day AND metric = 'page_view' AND dim LIKE '%|{c}') AS {c}" for c in U.CLASSES)


@query("h04_daily_series", f"""
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-20' - 29, DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day, (SELECT count(DISTINCT client_id) FROM ox_usage u WHERE u.day = d.day) AS active,
       (SELECT count(*) FROM fx_clients c WHERE CAST(c.created_at AS DATE) = d.day) AS "new",
       (SELECT CAST(coalesce(sum(calls), 0) AS BIGINT) FROM ox_usage u WHERE u.day = d.day) AS calls,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM ox_counts v WHERE v.day = d.day AND metric = 'anonymous_search') AS anon, {_VIEWS} FROM d""")
def h04(i):
    return U.daily_series(U.client_days(usage(i)).days, counts(i), i.fx_clients, "2024-01-20")


@query("h05_tool_table", f"""
SELECT tool, via, false AS anonymous, CAST(coalesce(sum(calls) FILTER (day = DATE '{TODAY}'), 0) AS BIGINT) AS today,
       CAST(coalesce(sum(calls) FILTER (day > DATE '{TODAY}' - 7), 0) AS BIGINT) AS d7, CAST(sum(calls) AS BIGINT) AS d30,
       count(DISTINCT client_id) AS clients30 FROM ox_usage WHERE day > DATE '{TODAY}' - 30 GROUP BY tool, via
UNION ALL
SELECT split_part(dim, ':', 2), split_part(dim, ':', 1), true, CAST(coalesce(sum(n) FILTER (day = DATE '{TODAY}'), 0) AS BIGINT),
       CAST(coalesce(sum(n) FILTER (day > DATE '{TODAY}' - 7), 0) AS BIGINT), CAST(sum(n) AS BIGINT), NULL
  FROM ox_counts WHERE metric = 'anonymous_search' AND day > DATE '{TODAY}' - 30 GROUP BY dim""")
def h05(i):
    return U.tool_table(usage(i), counts(i), TODAY)


@query("h06_app_table", f"""
SELECT dim AS client, CAST(coalesce(sum(n) FILTER (day > DATE '{TODAY}' - 7), 0) AS BIGINT) AS d7, CAST(sum(n) AS BIGINT) AS d30
  FROM ox_counts WHERE metric = 'mcp_connect' AND day > DATE '{TODAY}' - 30 GROUP BY dim ORDER BY d30 DESC, client LIMIT 20""")
def h06(i):
    return U.app_table(counts(i), TODAY, top=20)


@query("h06b_app_table_whole", f"""
SELECT dim AS client, CAST(coalesce(sum(n) FILTER (day > DATE '{TODAY}' - 7), 0) AS BIGINT) AS d7, CAST(sum(n) AS BIGINT) AS d30
  FROM ox_counts WHERE metric = 'mcp_connect' AND day > DATE '{TODAY}' - 30 GROUP BY dim""")
def h06b(i):
    return U.app_table(counts(i), TODAY)


@query("h07_source_table", """
WITH a AS (SELECT coalesce(source, '(none)') AS source, created_at > TIMESTAMP '2024-02-01 18:00:00' - INTERVAL 30 DAY AS is_new,
                  client_id IN (SELECT client_id FROM ox_usage WHERE day > DATE '2024-02-01' - 7) AS is_active FROM fx_clients)
SELECT source, count(*) FILTER (is_new) AS new30, count(*) FILTER (is_active) AS active7 FROM a GROUP BY 1
HAVING count(*) FILTER (is_new) > 0 OR count(*) FILTER (is_active) > 0""")
def h07(i):
    return U.source_table(i.fx_clients, usage(i), "2024-02-01", "2024-02-01 18:00:00")


@query("h08_page_table", "SELECT split_part(dim, '|', 1) AS path, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (dim LIKE '%|{c}'), 0) AS BIGINT) AS {c}" for c in U.CLASSES)
    + f" FROM ox_counts WHERE metric = 'page_view' AND day > DATE '{TODAY}' - 7 GROUP BY 1")
def h08(i):
    return U.page_table(counts(i), TODAY)


@query("h09_retention", f"""
WITH c AS (SELECT client_id, CAST(created_at AS DATE) AS first_day FROM fx_clients
            WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND CAST(created_at AS DATE) < DATE '{TODAY}')
SELECT count(*) AS cohort, count(*) FILTER ((SELECT max(day) FROM ox_usage u WHERE u.client_id = c.client_id) > first_day) AS returned FROM c""")
def h09(i):
    return U.retention(i.fx_clients, U.client_days(usage(i)), TODAY, NOW)


_MERGED = "SELECT concat('c', user_id) AS old_id, concat('c', user_id - 1) AS new_id FROM events WHERE user_id % 10 = 7 GROUP BY user_id"


@query("h10_merge_identities", f"""
SELECT day, coalesce(new_id, client_id) AS client_id, tool, via, CAST(sum(calls) AS BIGINT) AS calls
  FROM ox_usage LEFT JOIN ({_MERGED}) ON old_id = client_id GROUP BY ALL""")
def h10(i):
    return U.merge_identities(usage(i), i.sql(_MERGED))


_HITS = "SELECT ts, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'create' ELSE 'global' END AS name, concat('k', user_id % 20) AS key FROM events"
LIMITS = [{"name": "search", "max": 2, "window_seconds": 3600}, {"name": "global", "max": 3, "window_seconds": 7200}]


@query("h11_window_limits", f"""
SELECT name, key, strftime(make_timestamp(CAST(floor(epoch(ts) / n) * n AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) AS calls, count(*) > max(top) AS over_limit
  FROM ({_HITS}) JOIN (VALUES ('search', 2, 3600), ('global', 3, 7200)) s(name, top, n) USING (name) GROUP BY 1, 2, 3""")
def h11(i):
    out = U.window_limits(i.sql(_HITS), LIMITS)
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("h12_clients_by_source", f"""
SELECT coalesce(source, 'none') AS source, count(*) AS n FROM fx_clients WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1""")
def h12(i):
    return U.clients_by_source(i.fx_clients, NOW)


_OAUTH = "SELECT client_id, created_at, CASE WHEN source = 'src2' THEN 'oauth' ELSE source END AS source FROM fx_clients"
_CONNECTS = "SELECT concat('c', user_id) AS client_id, ts, CASE event_id % 3 WHEN 0 THEN '-bad tag' WHEN 1 THEN concat('Ref.', event_type) END AS ref FROM events"


@query("h13_attribute_sources", f"""
SELECT c.client_id, CASE WHEN c.source = 'oauth' THEN coalesce(t.tag, c.source) ELSE c.source END AS source FROM ({_OAUTH}) c
  LEFT JOIN (SELECT client_id, arg_min(lower(ref), ts) AS tag FROM ({_CONNECTS}) WHERE ref LIKE 'Ref.%' GROUP BY 1) t USING (client_id)""")
def h13(i):
    return U.attribute_sources(i.sql(_OAUTH), i.sql(_CONNECTS)).select("client_id", "source")
