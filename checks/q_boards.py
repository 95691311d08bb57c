"""G: board directory and check-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.shapes import postings
from checks.views import ORACLE_VIEWS
from jobdelta.operators import boards as B
from jobdelta.operators import health as H
from jobdelta.operators.robots import robots_filter
from jobdelta.operators.snapshot import monitored

NOW = "2024-01-20 12:00:00"
# Boards with check times, errors and a next check, in both dialects.
BOARDS = """SELECT *, TIMESTAMP_NTZ '2024-01-20 12:00:00' + INTERVAL '1' MINUTE * (CAST(substr(resource_id, 2) AS INT) * 7 % 400 - 300) AS next_check_at,
  TIMESTAMP_NTZ '2024-01-20 12:00:00' - INTERVAL '1' MINUTE * (CAST(substr(resource_id, 2) AS INT) * 11 % 150) AS last_checked_at,
  CASE consecutive_failures % 5 WHEN 1 THEN 'ACCESS_DENIED: x' WHEN 2 THEN 'HTTP_500: y' WHEN 3 THEN 'RATE_LIMITED: z' END AS last_error FROM fx_boards"""
DUCK_BOARDS = BOARDS.replace("TIMESTAMP_NTZ", "TIMESTAMP")
ORACLE_VIEWS["ox_boards"] = DUCK_BOARDS
WATCHED = "SELECT *, CASE WHEN baseline % 3 <> 0 THEN 300 + baseline * 400 END AS interval_seconds FROM fx_watches"
ORACLE_VIEWS["ox_monitored"] = "SELECT * FROM ox_boards WHERE indexed OR resource_id IN (SELECT resource_id FROM fx_watches WHERE resource_id IS NOT NULL)"


@query("g01_monitored", "SELECT resource_id, url FROM ox_monitored")
def g01(i):
    return monitored(i.fx_boards, i.fx_watches).select("resource_id", "url")


_WANTED = """SELECT concat('https://host', s_suppkey % 15, '.example/board/', s_suppkey) AS url,
    CASE WHEN s_suppkey % 3 = 0 THEN 'html' ELSE 'greenhouse' END AS adapter FROM supplier WHERE s_suppkey % 5 <> 4
    UNION ALL SELECT concat('https://new.example/', c_custkey), 'lever' FROM customer WHERE c_custkey % 20 = 0"""


def _sync_oracle(enabled):
    ours = "index_origin = 'directory'" if enabled else "true"
    return f"""
SELECT coalesce(b.url, w.url) AS url, coalesce(b.adapter, w.adapter) AS adapter,
       CASE WHEN w.url IS NOT NULL AND b.url IS NULL THEN 'add' WHEN w.url IS NOT NULL AND b.indexed THEN 'keep' WHEN w.url IS NOT NULL THEN 'index'
            WHEN b.indexed AND {ours} THEN 'drop' ELSE 'none' END AS action,
       CASE WHEN w.url IS NOT NULL THEN true WHEN b.indexed AND {ours} THEN false ELSE b.indexed END AS indexed
  FROM fx_boards b FULL OUTER JOIN ({_WANTED}) w ON b.url = w.url AND b.adapter = w.adapter"""


@query("g02_sync_directory", _sync_oracle(True))
def g02(i):
    return B.sync_directory(i.fx_boards, i.sql(_WANTED)).drop("index_origin")


@query("g02b_sync_directory_off", _sync_oracle(False))
def g02b(i):
    return B.sync_directory(i.fx_boards, i.sql(_WANTED), enabled=False).drop("index_origin")


@query("g03_promote", """
SELECT resource_id, url, adapter FROM ox_boards WHERE NOT indexed AND adapter = 'greenhouse' AND last_error IS NULL
   AND resource_id IN (SELECT resource_id FROM fx_watches) AND resource_id IN (SELECT resource_id FROM fx_now)
 ORDER BY url, resource_id LIMIT (SELECT 18 - count(*) FROM ox_boards WHERE indexed AND index_origin = 'watched')""")
def g03(i):
    return B.promote(i.sql(BOARDS), i.fx_watches, postings(i.fx_now), cap=18)


@query("g04_demote", """
SELECT resource_id, indexed AND NOT (coalesce(index_origin, '') = 'watched' AND consecutive_failures >= 8) AS indexed,
       CASE WHEN NOT (indexed AND coalesce(index_origin, '') = 'watched' AND consecutive_failures >= 8) THEN index_origin END AS index_origin FROM fx_boards""")
def g04(i):
    return B.demote(i.fx_boards).select("resource_id", "indexed", "index_origin")


_LEASES = "SELECT concat('host', s_suppkey % 15, '.example') AS host, TIMESTAMP_NTZ '2024-01-20 12:00:00' + INTERVAL '1' MINUTE * (s_suppkey % 15 - 9) AS leased_until FROM supplier"


@query("g05_due_boards", f"""
WITH l AS ({_LEASES.replace('TIMESTAMP_NTZ', 'TIMESTAMP')}), d AS (
  SELECT host, resource_id, next_check_at, row_number() OVER (PARTITION BY host ORDER BY next_check_at, resource_id) AS rn FROM ox_monitored
   WHERE next_check_at <= TIMESTAMP '{NOW}' AND host NOT IN (SELECT host FROM l WHERE leased_until > TIMESTAMP '{NOW}'))
SELECT host, resource_id FROM d WHERE rn = 1 ORDER BY next_check_at, resource_id LIMIT 6""")
def g05(i):
    return B.due_boards(i.sql(BOARDS), i.fx_watches, i.sql(_LEASES), NOW, 6).select("host", "resource_id")


@query("g06_effective_interval", f"""
SELECT b.resource_id, CAST(greatest(coalesce(least(CASE WHEN b.indexed THEN 14400 END, m.s), 3600), 300) AS BIGINT) AS interval_seconds
  FROM fx_boards b LEFT JOIN (SELECT resource_id, min(interval_seconds) AS s FROM ({WATCHED}) GROUP BY 1) m USING (resource_id)""")
def g06(i):
    return B.effective_interval(i.fx_boards, i.sql(WATCHED))


_RESULTS = """SELECT event_id AS check_id, ts AS checked_at, CASE event_id % 6 WHEN 0 THEN 'ACCESS_DENIED' WHEN 1 THEN 'HTTP_500' WHEN 2 THEN 'RATE_LIMITED' WHEN 3 THEN 'TIMEOUT' END AS code,
  CAST(user_id % 12 AS INT) AS consecutive_failures, 300 * (1 + user_id % 40) AS interval_seconds,
  CASE WHEN event_id % 6 = 2 THEN CAST(event_id * 37 % 900000 AS INT) END AS retry_after FROM events"""


@query("g07_next_check", f"""
WITH r AS ({_RESULTS}), d AS (SELECT *, CASE WHEN code = 'ACCESS_DENIED' THEN 86400.0 ELSE least(interval_seconds * pow(2, least(consecutive_failures + 1, 6)), 86400) END AS delay FROM r)
SELECT check_id, CAST(CASE WHEN code IS NULL THEN 0 ELSE consecutive_failures + 1 END AS INTEGER) AS consecutive_failures,
       strftime(checked_at + to_seconds(CASE WHEN code IS NULL THEN interval_seconds WHEN retry_after IS NOT NULL THEN least(greatest(delay, retry_after), 604800) ELSE delay END), '%Y-%m-%d %H:%M:%S') AS next_check_at
  FROM d""")
def g07(i):
    return B.next_check(i.sql(_RESULTS)).select("check_id", "consecutive_failures",
                                                F.date_format("next_check_at", "yyyy-MM-dd HH:mm:ss").alias("next_check_at"))


@query("g08_failure_streak", """
SELECT resource_id, CAST(count(*) FILTER (outcome = 'error' AND (checked_at, check_id) > coalesce(last_ok, (TIMESTAMP '1900-01-01', 0))) AS INTEGER) AS consecutive_failures
  FROM (SELECT *, max((checked_at, check_id)) FILTER (outcome <> 'error') OVER (PARTITION BY resource_id) AS last_ok FROM fx_check_log) GROUP BY 1""")
def g08(i):
    return B.failure_streak(i.fx_check_log)


_FETCHES = """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 402 WHEN 4 THEN 304 WHEN 5 THEN 500 WHEN 6 THEN 401 ELSE 200 END AS status,
  concat(props, CASE user_id % 4 WHEN 0 THEN ' please solve the reCAPTCHA' WHEN 1 THEN ' Access Denied' ELSE ' fine' END) AS body FROM events"""


@query("g09_classify_fetches", f"""
SELECT id, CASE WHEN status = 304 THEN 'NOT_MODIFIED' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status < 400 THEN 'OK'
    WHEN status IN (401, 403, 503) AND (body ILIKE '%captcha%' OR body ILIKE '%access denied%') THEN 'BOT_CHALLENGE'
    WHEN status IN (401, 402, 403) THEN 'ACCESS_DENIED' ELSE concat('HTTP_', status) END AS code FROM ({_FETCHES})""")
def g09(i):
    return B.classify_fetches(i.sql(_FETCHES)).select("id", "code")


# A robots file per host of the crawled pages, of a kind picked by the host name's length.
_HOSTS = "SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM pages"
_ROBOTS = f"""SELECT origin, CASE length(origin) % 7 WHEN 0 THEN 503 WHEN 1 THEN 404 ELSE 200 END AS status,
  CASE length(origin) % 7
    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow: /en/', chr(10), 'Allow: /en/1*', chr(10), 'Disallow: /*.html$', chr(10))
    WHEN 3 THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: other', chr(10), 'User-agent: JobDelta # us', chr(10), 'Disallow: /fr', chr(10), 'Crawl-delay: 5', chr(10), 'Disallow: /es/*?page=')
    WHEN 4 THEN concat('# nothing', chr(10), 'User-agent: *', chr(13), chr(10), 'Disallow:', chr(10))
    WHEN 5 THEN concat('Disallow: /ignored', chr(10), 'user-agent: *', chr(10), 'DISALLOW: /en/5', chr(10), 'allow: /en/5', chr(10), 'Disallow: /*?')
    ELSE 'no rules at all' END AS body FROM ({_HOSTS})"""


@query("g10_robots_filter", r"""
WITH p AS (SELECT page_id, url, length(regexp_extract(url, '^(https?://[^/]+)', 1)) % 7 AS kind,
                  regexp_extract(url, '^https?://[^/]+([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE kind WHEN 0 THEN false
    WHEN 2 THEN NOT ((starts_with(path, '/en/') AND NOT starts_with(path, '/en/1')) OR regexp_matches(path, '^/.*\.html$'))
    WHEN 3 THEN NOT (starts_with(path, '/fr') OR regexp_matches(path, '^/es/.*\?page='))
    WHEN 5 THEN NOT (contains(path, '?') AND NOT starts_with(path, '/en/5')) ELSE true END AS allowed FROM p""")
def g10(i):
    return robots_filter(i.pages, i.sql(_ROBOTS), "jobdeltabot").select("page_id", "allowed")


_LINKS = """SELECT page_id, concat(html, '<a href="https://boards.greenhouse.io/acme', page_id % 20, '">jobs</a>',
   '<iframe src="https://boards.eu.greenhouse.io/embed/job_board?x=1&amp;for=Emb', page_id % 3, '"></iframe>',
   '<a href="https://jobs.lever.co/lev', page_id % 7, '/123">a</a><a href="//jobs.lever.co/lev', page_id % 7, '">b</a>',
   '<a href="https://apply.workable.com/api">x</a><a href="https://Team', page_id % 5, '.recruitee.com/o/1">r</a>',
   '<a href="https://big', page_id % 4, '.wd5.myworkdayjobs.com/en-US/Ext">w</a>') AS html FROM pages"""


@query("g11_board_links", """
SELECT page_id, concat('https://jobs.lever.co/lev', page_id % 7) AS board, CAST(2 AS BIGINT) AS mentions, CAST(1 AS BIGINT) AS rank FROM pages
UNION ALL SELECT page_id, concat('https://boards.eu.greenhouse.io/Emb', page_id % 3), 1, 2 FROM pages
UNION ALL SELECT page_id, concat('https://boards.greenhouse.io/acme', page_id % 20), 1, 3 FROM pages
UNION ALL SELECT page_id, concat('https://team', page_id % 5, '.recruitee.com'), 1, 4 FROM pages
UNION ALL SELECT page_id, concat('https://big', page_id % 4, '.wd5.myworkdayjobs.com/Ext'), 1, 5 FROM pages""")
def g11(i):
    return B.board_links(i.sql(_LINKS)).withColumn("rank", F.col("rank").cast("bigint"))


_COMPANIES = """SELECT CASE c_custkey % 4 WHEN 0 THEN concat('Acme & Söns ', c_custkey, ' Inc.') WHEN 1 THEN concat('Blue Labs ', c_custkey)
    WHEN 2 THEN concat('Widget ', c_custkey, ' Technologies') ELSE concat('No Site ', c_custkey) END AS name,
  CASE c_custkey % 4 WHEN 0 THEN concat('https://www.acme', c_custkey, '.com/about') WHEN 1 THEN concat('blue', c_custkey, '.co.uk')
    WHEN 2 THEN concat('http://app.widget', c_custkey, '.io') END AS website FROM customer"""


@query("g12_careers_candidates", f"""
WITH c AS (SELECT name, concat('https://', regexp_extract(website, '^(?:https?://)?([^/]+)', 1)) AS origin FROM ({_COMPANIES}) WHERE website IS NOT NULL)
SELECT name, 0 AS position, concat(origin, '/careers') AS url FROM c UNION ALL SELECT name, 1, concat(origin, '/jobs') FROM c UNION ALL SELECT name, 2, origin FROM c""")
def g12(i):
    return B.careers_candidates(i.sql(_COMPANIES))


@query("g13_slug_candidates", """
WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN [concat('acme', c_custkey), concat('acmeandsons', c_custkey), concat('acme-and-sons-', c_custkey)]
   WHEN 1 THEN [concat('blue', c_custkey), concat('bluelabs', c_custkey), concat('blue-labs-', c_custkey)]
   WHEN 2 THEN [concat('widget', c_custkey), concat('widget-', c_custkey)] ELSE [concat('nosite', c_custkey), concat('no-site-', c_custkey)] END AS s,
   CASE c_custkey % 4 WHEN 0 THEN concat('Acme & Söns ', c_custkey, ' Inc.') WHEN 1 THEN concat('Blue Labs ', c_custkey)
    WHEN 2 THEN concat('Widget ', c_custkey, ' Technologies') ELSE concat('No Site ', c_custkey) END AS name FROM customer)
SELECT name, CAST(unnest(range(len(s))) AS INTEGER) AS position, unnest(s) AS slug FROM c""")
def g13(i):
    return B.slug_candidates(i.sql(_COMPANIES))


_CANDIDATES = """SELECT concat('co', o_custkey) AS company, CASE o_orderkey % 4 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' ELSE 'workable' END AS platform,
  concat('Slug', o_orderkey % 300) AS slug, CASE WHEN o_orderkey % 5 = 0 THEN 'careers-page' ELSE 'name' END AS via, CAST(o_orderkey % 3 AS INT) AS position FROM orders"""
_LISTED = """SELECT CASE c_custkey % 4 WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' ELSE 'workable' END AS platform,
  concat('slug', c_custkey) AS slug, CAST(c_custkey * 7 % 40 AS INT) AS jobs FROM customer"""
_CONFIRMED = f"""SELECT company, concat(CASE platform WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/'
      WHEN 'lever' THEN 'https://jobs.lever.co/' ELSE 'https://apply.workable.com/' END, slug) AS board, platform, jobs, via FROM (
  SELECT c.*, l.jobs, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN via = 'careers-page' THEN 0 ELSE 1 END, position, -jobs, c.platform, c.slug) AS rn
    FROM ({_CANDIDATES}) c JOIN ({_LISTED}) l ON l.platform = c.platform AND l.slug = lower(c.slug) WHERE jobs > 0 AND (via = 'careers-page' OR c.platform <> 'workable')) WHERE rn = 1"""


@query("g14_confirm_boards", _CONFIRMED)
def g14(i):
    return B.confirm_boards(i.sql(_CANDIDATES), i.sql(_LISTED))


@query("g15_discovery_summary", f"""
SELECT platform, count(*) FILTER (via = 'careers-page') AS careers_page, count(*) FILTER (via = 'name') AS name FROM ({_CONFIRMED}) GROUP BY 1""")
def g15(i):
    return B.discovery_summary(B.confirm_boards(i.sql(_CANDIDATES), i.sql(_LISTED)))


@query("g16_cap_audit", """
WITH w AS (SELECT w.client_id, b.resource_id, b.host, b.adapter FROM fx_watches w JOIN fx_boards b USING (resource_id)),
a AS (SELECT * FROM fx_boards WHERE resource_id IN (SELECT resource_id FROM fx_watches))
SELECT 'client' AS kind, client_id AS name, count(*) AS n, CAST(12 AS BIGINT) AS cap, count(*) > 12 AS over FROM w GROUP BY 2
UNION ALL SELECT 'client_host', concat_ws('@', client_id, host), count(*), 4, count(*) > 4 FROM w WHERE adapter = 'html' GROUP BY client_id, host
UNION ALL SELECT 'host', host, count(*), 1, count(*) > 1 FROM a WHERE adapter = 'html' GROUP BY 2
UNION ALL SELECT 'boards', 'all', count(*), 50000, count(*) > 50000 FROM a""")
def g16(i):
    return B.cap_audit(i.fx_watches, i.fx_boards, 12, 4, 1, 50_000)


@query("g17_check_counts", "SELECT outcome, code, count(*) AS n FROM fx_check_log GROUP BY 1, 2")
def g17(i):
    return H.check_counts(i.fx_check_log)


@query("g18_duration_histogram", " UNION ALL ".join(
    f"SELECT '{b:g}' AS le, count(*) FILTER (seconds <= {b}) AS n FROM fx_check_log" for b in H.BUCKETS)
    + " UNION ALL SELECT '+Inf', count(*) FROM fx_check_log")
def g18(i):
    return H.duration_histogram(i.fx_check_log)


@query("g18b_duration_totals", "SELECT round(sum(seconds), 4) AS sum, count(*) AS count FROM fx_check_log")
def g18b(i):
    return H.duration_totals(i.fx_check_log).select(F.round("sum", 4).alias("sum"), "count")


@query("g19_cap_series", """
WITH f AS (SELECT concat('u', user_id) AS label, min(ts) AS first FROM events GROUP BY 1), k AS (SELECT label FROM f ORDER BY first, label LIMIT 12)
SELECT CASE WHEN concat('u', user_id) IN (SELECT label FROM k) THEN concat('u', user_id) ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1""")
def g19(i):
    return H.cap_series(i.events.select("ts", F.concat(F.lit("u"), "user_id").alias("label")), 12)


_OUTBOX = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'delivered' ELSE 'failed' END AS status FROM orders"


@query("g20_health", f"""
SELECT 'watches' AS gauge, count(*) AS value FROM fx_watches UNION ALL SELECT 'search_watches', count(*) FROM fx_watches WHERE resource_id IS NULL
UNION ALL SELECT 'watched_boards', count(DISTINCT resource_id) FROM fx_watches UNION ALL SELECT 'directory', count(*) FROM ox_boards WHERE indexed
UNION ALL SELECT 'overdue', count(*) FROM ox_boards WHERE indexed AND consecutive_failures = 0 AND next_check_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
UNION ALL SELECT 'failing', count(*) FROM ox_boards WHERE consecutive_failures > 0
UNION ALL SELECT 'blocked', count(*) FROM ox_boards WHERE last_checked_at > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND regexp_matches(last_error, '^(BOT_CHALLENGE|ACCESS_DENIED|RATE_LIMITED)')
UNION ALL SELECT 'outbox_pending', count(*) FROM ({_OUTBOX}) WHERE status = 'pending'""")
def g20(i):
    return H.health(i.sql(BOARDS), i.fx_watches, i.sql(_OUTBOX), NOW)


def _bucket_sql():
    cases, lower, below = [], 0.0, "0"
    for b in H.BUCKETS:
        cases.append(f"WHEN b{k(b)} >= r THEN {lower} + {b - lower} * (r - {below}) / nullif(b{k(b)} - {below}, 0)")
        lower, below = float(b), f"b{k(b)}"
    return f"CASE {' '.join(cases)} ELSE 20.0 END"


def k(b):
    return str(b).replace(".", "_")


ORACLE_VIEWS["ox_windows"] = f"""
SELECT ends_at, n AS checks, errors, errors / n AS error_ratio, {_bucket_sql()} AS p95 FROM (
  SELECT ends_at, count(*) AS n, count(*) FILTER (outcome = 'error') AS errors, 0.95 * count(*) AS r,
         {', '.join(f'count(*) FILTER (seconds <= {b}) AS b{k(b)}' for b in H.BUCKETS)}
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, checked_at) + INTERVAL 5 MINUTE * unnest([1, 2, 3]) AS ends_at FROM fx_check_log) GROUP BY 1)"""


@query("g21_check_windows", """
SELECT strftime(ends_at, '%Y-%m-%d %H:%M:%S') AS ends_at, checks, errors, round(error_ratio, 6) AS error_ratio, round(p95, 6) AS p95 FROM ox_windows""")
def g21(i):
    return H.check_windows(i.fx_check_log).select(
        F.date_format("ends_at", "yyyy-MM-dd HH:mm:ss").alias("ends_at"), "checks", "errors",
        F.round("error_ratio", 6).alias("error_ratio"), F.round("p95", 6).alias("p95"))


@query("g21b_log_alerts", """
WITH bad AS (SELECT 'errors_high' AS alert, ends_at FROM ox_windows WHERE error_ratio > 0.25 UNION ALL SELECT 'slow', ends_at FROM ox_windows WHERE p95 > 10),
e AS (SELECT min(checked_at) AS a, max(checked_at) AS b FROM fx_check_log),
t AS (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, a) + INTERVAL 30 MINUTE, time_bucket(INTERVAL 5 MINUTE, b), INTERVAL 5 MINUTE)) AS ends_at FROM e),
busy AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, checked_at) + INTERVAL 5 MINUTE * unnest([1, 2, 3, 4, 5, 6]) AS ends_at FROM fx_check_log),
idle AS (SELECT 'stalled' AS alert, ends_at FROM t WHERE ends_at NOT IN (SELECT ends_at FROM busy)),
h AS (SELECT alert, ends_at + INTERVAL 5 MINUTE * unnest([0, 1, 2, 3, 4, 5, 6]) AS ends_at, 7 AS need FROM bad
      UNION ALL SELECT alert, ends_at + INTERVAL 5 MINUTE * unnest([0, 1, 2, 3]), 4 FROM idle)
SELECT alert, strftime(ends_at, '%Y-%m-%d %H:%M:%S') AS ends_at FROM h GROUP BY alert, ends_at, need HAVING count(*) = need""")
def g21b(i):
    return H.log_alerts(i.fx_check_log).select("alert", F.date_format("ends_at", "yyyy-MM-dd HH:mm:ss").alias("ends_at"))


@query("g21c_gauge_alerts", f"""
SELECT 'blocked' AS alert, count(*) AS value, count(*) > 10 AS firing FROM ox_boards WHERE last_checked_at > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND regexp_matches(last_error, '^(BOT_CHALLENGE|ACCESS_DENIED|RATE_LIMITED)')
UNION ALL SELECT 'outbox_pending', count(*), count(*) > 500 FROM ({_OUTBOX}) WHERE status = 'pending'
UNION ALL SELECT 'overdue', count(*), count(*) > 100 FROM ox_boards WHERE indexed AND consecutive_failures = 0 AND next_check_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR
UNION ALL SELECT 'stalled', count(DISTINCT resource_id), (SELECT count(*) FROM fx_check_log WHERE checked_at > TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE) = 0 FROM fx_watches""")
def g21c(i):
    return H.gauge_alerts(H.health(i.sql(BOARDS), i.fx_watches, i.sql(_OUTBOX), NOW), i.fx_check_log, NOW)
