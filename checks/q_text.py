"""C: enrichment columns; A3, A4, A7, A8, D1."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, spread
from checks.views import ORACLE_VIEWS, ox_label, ox_remote, ox_seniority, ox_term
from jobdelta.functions import pay as P
from jobdelta.functions import text as X
from jobdelta.functions import urls as U
from jobdelta.functions.sql import register_functions
from jobdelta.operators.boards import dedupe_boards

WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _decoded(c):
    for name, ch in X.NAMED_ENTITIES.items():
        if name != "amp":
            c = f"regexp_replace({c}, '(?i)&{name};', '{ch.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"regexp_replace({c}, '(?i)&amp;', '&', 'g')"


# Pages, and pages whose markup was escaped once, as one platform sends posting text.
HTML = """SELECT page_id, html FROM pages UNION ALL
  SELECT -1 - page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') FROM pages"""


@query("c01_html_to_text", f"""
WITH s AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?i)&lt;/?[a-z]') THEN {_decoded('html')} ELSE html END AS h FROM ({HTML})),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM s)
SELECT page_id, md5(trim(regexp_replace({_decoded('h')}, '{WS}+', ' ', 'g'))) AS text, length(trim(regexp_replace({_decoded('h')}, '{WS}+', ' ', 'g'))) AS chars FROM b""")
def c01(i):
    text = X.html_to_text(F.col("html"))
    return i.sql(HTML).select("page_id", text.alias("t")).select(
        "page_id", F.md5(F.col("t").cast("binary")).alias("text"), F.length("t").cast("bigint").alias("chars"))


# What fx_pay_text was built to say.
_PAY = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(60000 + o_orderkey % 90 * 1000 AS DOUBLE) WHEN 1 THEN CAST(20 + o_orderkey % 60 AS DOUBLE) END AS "min",
  CASE o_orderkey % 4 WHEN 0 THEN CAST(90000 + o_orderkey % 90 * 1000 AS DOUBLE) WHEN 1 THEN CAST(30 + o_orderkey % 60 AS DOUBLE) END AS "max",
  CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'hour' END AS period, CASE WHEN o_orderkey % 4 < 2 THEN 'USD' END AS currency,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 60000 + o_orderkey % 90 * 1000 WHEN 1 THEN 2080 * (20 + o_orderkey % 60) END AS BIGINT) AS annual_min,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 90000 + o_orderkey % 90 * 1000 WHEN 1 THEN 2080 * (30 + o_orderkey % 60) END AS BIGINT) AS annual_max FROM orders"""


@query("c02_parse_salary", _PAY)
def c02(i):
    return spread(i.fx_pay_text).select("id", P.parse_salary(F.col("text")).alias("s")).select(
        "id", "s.min", "s.max", "s.period", "s.currency", "s.annual_min", "s.annual_max")


RANGES = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 4 <> 3 THEN l_extendedprice / (1 + l_orderkey % 400) END AS low,
    CASE WHEN l_linenumber % 5 <> 2 THEN l_extendedprice / (1 + l_partkey % 400) END AS high,
    CASE l_suppkey % 5 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'week' WHEN 3 THEN 'day' ELSE 'hour' END AS period, lower(l_returnflag) AS currency FROM lineitem"""


@query("c03_make_salary", f"""
WITH b AS (SELECT *, CASE period WHEN 'year' THEN 10000 WHEN 'month' THEN 500 WHEN 'week' THEN 200 WHEN 'day' THEN 40 ELSE 5 END AS bot,
    CASE period WHEN 'year' THEN 5000000 WHEN 'month' THEN 400000 WHEN 'week' THEN 100000 WHEN 'day' THEN 20000 ELSE 1000 END AS top,
    CASE period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 WHEN 'day' THEN 260 ELSE 2080 END AS k FROM ({RANGES})),
o AS (SELECT *, CASE WHEN low BETWEEN bot AND top THEN low END AS a, CASE WHEN high BETWEEN bot AND top THEN high END AS z FROM b),
s AS (SELECT id, upper(currency) AS currency, period, k, CASE WHEN a > z THEN z ELSE a END AS "min", CASE WHEN a > z THEN a ELSE z END AS "max", coalesce(a, z) IS NOT NULL AS ok FROM o)
SELECT id, "min", "max", CASE WHEN ok THEN currency END AS currency, CASE WHEN ok THEN period END AS period,
       CAST(floor("min" * k + 0.5) AS BIGINT) AS annual_min, CAST(floor("max" * k + 0.5) AS BIGINT) AS annual_max FROM s""")
def c03(i):
    s = P.make_salary(F.col("low"), F.col("high"), F.col("period"), F.col("currency"))
    return i.sql(RANGES).select("id", s.alias("s")).select("id", "s.*")


PERIODS = """SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN '1 YEAR' WHEN 1 THEN 'per-year-salary' WHEN 2 THEN 'HOUR' WHEN 3 THEN 'monthly'
   WHEN 4 THEN 'Daily rate' WHEN 5 THEN 'per week' WHEN 6 THEN '$/hr' WHEN 7 THEN 'yr' WHEN 8 THEN 'days of the year' WHEN 9 THEN o_orderpriority WHEN 10 THEN 'thrice' END AS words FROM orders"""


@query("c04_period_of", f"""
SELECT id, CASE id % 12 WHEN 0 THEN 'year' WHEN 1 THEN 'year' WHEN 2 THEN 'hour' WHEN 3 THEN 'month' WHEN 4 THEN 'day' WHEN 5 THEN 'week' WHEN 6 THEN 'hour'
   WHEN 7 THEN 'year' WHEN 8 THEN 'year' END AS period FROM ({PERIODS})""")
def c04(i):
    return i.sql(PERIODS).select("id", P.period_of(F.col("words")).alias("period"))


_YEARS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 12 AS DOUBLE) END AS years FROM orders"""


@query("c05_parse_experience", _YEARS)
def c05(i):
    return spread(i.fx_pay_text).select("id", P.parse_experience(F.col("text")).alias("years"))


@query("c06_posting_details", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 111000 WHEN o_orderkey % 4 = 0 THEN 60000 + o_orderkey % 90 * 1000
         WHEN o_orderkey % 4 = 1 THEN 2080 * (20 + o_orderkey % 60) END AS BIGINT) AS annual_min,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 12 AS DOUBLE) END AS years FROM orders""")
def c06(i):
    own = F.when(F.col("id") % 10 == 0, P.make_salary(F.lit(111000), F.lit(None), F.lit("year"), F.lit("usd")))
    out = P.posting_details(spread(i.fx_pay_text), [F.lit("Clerk"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>&nbsp;"))], own)
    return out.select("id", "salary.annual_min", F.col("experience_years").alias("years"))


TITLES = """SELECT l_orderkey * 10 + l_linenumber AS id, concat(CASE l_partkey % 24 WHEN 0 THEN 'Sr. ' WHEN 1 THEN 'Senior Engineering Manager, ' WHEN 2 THEN 'Software Engineer II ' WHEN 3 THEN 'Data Engineer III ' WHEN 4 THEN 'Head of '
     WHEN 5 THEN 'Summer Internship ' WHEN 6 THEN 'International ' WHEN 7 THEN 'Entry-Level ' WHEN 8 THEN 'New Grad ' WHEN 9 THEN 'Señor ' WHEN 10 THEN 'VP, ' WHEN 11 THEN 'Staffing ' WHEN 12 THEN 'Co-op ' WHEN 13 THEN 'Graduate ' WHEN 14 THEN 'Lead/' WHEN 15 THEN 'Analyst I ' WHEN 16 THEN 'Jr ' WHEN 17 THEN 'Solutions Architect ' ELSE '' END, p_name) AS title,
  CASE l_suppkey % 9 WHEN 0 THEN 'Remote, US' WHEN 1 THEN 'Not remote' WHEN 2 THEN 'On-site' WHEN 3 THEN 'Remote (Hybrid)' WHEN 4 THEN 'Anywhere' WHEN 5 THEN NULL WHEN 6 THEN 'Remotely-ish' WHEN 7 THEN 'Work from home' ELSE 'non-remote' END AS location,
  p_brand AS department, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE p_type END AS company FROM lineitem JOIN part ON l_partkey = p_partkey"""
ORACLE_VIEWS["ox_titles"] = TITLES


@query("c07_is_remote", f"SELECT id, {ox_remote('title', 'location')} AS remote FROM ox_titles")
def c07(i):
    return i.sql(TITLES).select("id", X.is_remote(F.col("title"), F.col("location")).alias("remote"))


@query("c08_seniority", f"SELECT id, {ox_seniority('title')} AS seniority FROM ox_titles")
def c08(i):
    return spread(i.sql(TITLES)).select("id", X.seniority(F.col("title")).alias("seniority"))


@query("c09_search_text", """
SELECT id, lower(concat_ws(' ', nullif(title, ''), nullif(location, ''), nullif(department, ''), nullif(company, ''))) AS search_text FROM ox_titles""")
def c09(i):
    cols = [F.col(c) for c in ("title", "location", "department", "company")]
    return i.sql(TITLES).select("id", X.search_text(*cols).alias("search_text"))


@query("c10_location_text", """
SELECT id, lower(concat(coalesce(location, ''), ' ', CASE WHEN id % 3 <> 0 THEN concat(department, ' | ', company) ELSE '' END)) AS location_text FROM ox_titles""")
def c10(i):
    others = F.when(F.col("id") % 3 != 0, F.array("department", "company"))
    return i.sql(TITLES).select("id", X.location_text(F.col("location"), others).alias("location_text"))


_TERMS = ["ring", "c++", ".net", "new york", "remote", "manager, red", "i"]
_TEXTS = """SELECT p_partkey AS id, lower(concat(p_name, CASE p_partkey % 8 WHEN 0 THEN 's' WHEN 1 THEN 'es' WHEN 2 THEN ' c++ and c' WHEN 3 THEN ' asp.net' WHEN 4 THEN ' .net, new york' WHEN 5 THEN 'ish (.NETs)' WHEN 6 THEN ' new  york remotely' ELSE '-ring manager, red' END)) AS text FROM part"""


@query("c11_term_match", " UNION ALL ".join(
    f"SELECT id, '{t}' AS term, {ox_term('text', chr(39) + t + chr(39))} AS hit FROM ({_TEXTS})" for t in _TERMS))
def c11(i):
    register_functions(i.spark)
    rows = i.sql(_TEXTS).withColumn("term", F.explode(F.array(*[F.lit(t) for t in _TERMS])))
    return rows.select("id", "term", F.expr("term_match(text, term)").alias("sql_hit"), X.term_match(F.col("text"), F.col("term")).alias("hit")) \
        .select("id", "term", (F.col("hit") & F.col("sql_hit")).alias("hit"))


@query("k01_sql_parse_salary", _PAY)
def k01(i):
    register_functions(i.spark)
    return spread(i.fx_pay_text).select("id", F.expr("parse_salary(text)").alias("s")).select("id", "s.min", "s.max", "s.period", "s.currency", "s.annual_min", "s.annual_max")


@query("k02_sql_parse_experience", _YEARS)
def k02(i):
    register_functions(i.spark)
    return spread(i.fx_pay_text).select("id", F.expr("parse_experience(text)").alias("years"))


_BOARD_URLS = """SELECT s_suppkey AS id, CASE s_suppkey % 12 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workable' WHEN 4 THEN 'smartrecruiters' WHEN 5 THEN 'recruitee'
     WHEN 6 THEN 'workday' WHEN 7 THEN 'icims' WHEN 8 THEN 'apple' WHEN 9 THEN 'oracle' WHEN 10 THEN 'eightfold' ELSE 'html' END AS adapter,
   CASE s_suppkey % 12 WHEN 0 THEN concat('https://boards-api.greenhouse.io/v1/boards/acme-robotics', s_suppkey, '/jobs') WHEN 1 THEN concat('https://api.eu.lever.co/v0/postings/blue_box.', s_suppkey, '?mode=json')
     WHEN 2 THEN concat('https://api.ashbyhq.com/posting-api/job-board/The%20Co', s_suppkey) WHEN 3 THEN concat('https://apply.workable.com/api/v1/widget/accounts/wk-', s_suppkey)
     WHEN 4 THEN concat('https://api.smartrecruiters.com/v1/companies/Smart', s_suppkey, '/postings?limit=100') WHEN 5 THEN concat('https://rec-', s_suppkey, '.recruitee.com/api/offers/')
     WHEN 6 THEN concat('https://big', s_suppkey, '.wd5.myworkdayjobs.com/wday/cxs/big', s_suppkey, '/External/jobs') WHEN 7 THEN concat('https://careers-ice', s_suppkey, '.icims.com/sitemap.xml')
     WHEN 8 THEN 'https://jobs.apple.com/api/v1/search' WHEN 9 THEN concat('https://x', s_suppkey, '.fa.us2.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&finder=findReqs;siteNumber=CX_', s_suppkey, ',limit=100')
     WHEN 10 THEN concat('https://tenant', s_suppkey, '.eightfold.ai/api/pcsx/search?domain=tenant', s_suppkey, '.com&query=') ELSE concat('https://site', s_suppkey, '.example/careers') END AS url FROM supplier"""


@query("c12_company_from_board", f"""
SELECT id, CASE id % 12 WHEN 0 THEN concat('Acme Robotics', id) WHEN 1 THEN concat('Blue Box ', id) WHEN 2 THEN concat('The Co', id) WHEN 3 THEN concat('Wk ', id) WHEN 4 THEN concat('Smart', id)
  WHEN 5 THEN concat('Rec ', id) WHEN 6 THEN concat('Big', id) WHEN 7 THEN concat('Ice', id) WHEN 8 THEN 'Apple' WHEN 10 THEN concat('Tenant', id) END AS company FROM ({_BOARD_URLS})""")
def c12(i):
    return i.sql(_BOARD_URLS).select("id", U.company_from_board(F.col("adapter"), F.col("url")).alias("company"))


@query("c13_canonical_url", r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
   list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z_]+|fbclid|gclid)='))) AS q FROM pages)
SELECT page_id, concat(origin, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END) AS url FROM u""")
def c13(i):
    return i.pages.select("page_id", U.canonical_url(F.col("url")).alias("url"))


_SPELLINGS = """SELECT s_suppkey AS id, CASE s_suppkey % 14 WHEN 0 THEN concat('https://boards.greenhouse.io/Acme', s_suppkey) WHEN 1 THEN concat('https://job-boards.eu.greenhouse.io/acme', s_suppkey, '/jobs/1')
   WHEN 2 THEN concat('https://boards.greenhouse.io/embed/job_board?for=acme', s_suppkey) WHEN 3 THEN concat('https://JOBS.lever.co/lev', s_suppkey, '/x') WHEN 4 THEN concat('https://jobs.ashbyhq.com/ash', s_suppkey)
   WHEN 5 THEN concat('https://wk', s_suppkey, '.workable.com/') WHEN 6 THEN concat('https://careers.smartrecruiters.com/Sm', s_suppkey) WHEN 7 THEN concat('https://rc', s_suppkey, '.recruitee.com/o/x')
   WHEN 8 THEN concat('https://t', s_suppkey, '.wd5.myworkdayjobs.com/en-US/Ext') WHEN 9 THEN concat('https://wd3.myworkdaysite.com/recruiting/t', s_suppkey, '/Ext/job/1') WHEN 10 THEN concat('https://careers-i', s_suppkey, '.icims.com/jobs/intro')
   WHEN 11 THEN concat('https://o', s_suppkey, '.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/5') WHEN 12 THEN concat('https://e', s_suppkey, '.eightfold.ai/careers?domain=E', s_suppkey, '.org')
   ELSE concat('HTTPS://Site', s_suppkey, '.example:443/Careers?b=2&utm_source=x&a=1#top') END AS url FROM supplier"""
_RESOLVED = f"""SELECT id, CASE id % 14 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'lever' WHEN 4 THEN 'ashby' WHEN 5 THEN 'workable' WHEN 6 THEN 'smartrecruiters'
   WHEN 7 THEN 'recruitee' WHEN 8 THEN 'workday' WHEN 9 THEN 'workday' WHEN 10 THEN 'icims' WHEN 11 THEN 'oracle' WHEN 12 THEN 'eightfold' ELSE 'html' END AS adapter,
 CASE id % 14 WHEN 0 THEN concat('https://boards-api.greenhouse.io/v1/boards/Acme', id, '/jobs') WHEN 1 THEN concat('https://boards-api.eu.greenhouse.io/v1/boards/acme', id, '/jobs')
   WHEN 2 THEN concat('https://boards-api.greenhouse.io/v1/boards/acme', id, '/jobs') WHEN 3 THEN concat('https://api.lever.co/v0/postings/lev', id, '?mode=json') WHEN 4 THEN concat('https://api.ashbyhq.com/posting-api/job-board/ash', id)
   WHEN 5 THEN concat('https://apply.workable.com/api/v1/widget/accounts/wk', id) WHEN 6 THEN concat('https://api.smartrecruiters.com/v1/companies/Sm', id, '/postings?limit=100') WHEN 7 THEN concat('https://rc', id, '.recruitee.com/api/offers/')
   WHEN 8 THEN concat('https://t', id, '.wd5.myworkdayjobs.com/wday/cxs/t', id, '/Ext/jobs') WHEN 9 THEN concat('https://wd3.myworkdaysite.com/wday/cxs/t', id, '/Ext/jobs') WHEN 10 THEN concat('https://careers-i', id, '.icims.com/sitemap.xml')
   WHEN 11 THEN concat('https://o', id, '.fa.us2.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList.secondaryLocations&finder=findReqs;siteNumber=CX_1,limit=100,offset=0,sortBy=POSTING_DATES_DESC')
   WHEN 12 THEN concat('https://e', id, '.eightfold.ai/api/pcsx/search?domain=e', id, '.org&query=&location=&start=0&sort_by=timestamp') ELSE concat('https://site', id, '.example/Careers?a=1&b=2') END AS fetch_url FROM ({_SPELLINGS})"""


@query("c14_resolve_source", _RESOLVED)
def c14(i):
    return i.sql(_SPELLINGS).select("id", U.resolve_source(F.col("url")).alias("s")).select("id", "s.*")


@query("c15_board_page_url", f"""
SELECT id, CASE id % 14 WHEN 0 THEN concat('https://job-boards.greenhouse.io/Acme', id) WHEN 1 THEN concat('https://job-boards.eu.greenhouse.io/acme', id) WHEN 2 THEN concat('https://job-boards.greenhouse.io/acme', id)
   WHEN 3 THEN concat('https://jobs.lever.co/lev', id) WHEN 4 THEN concat('https://jobs.ashbyhq.com/ash', id) WHEN 5 THEN concat('https://apply.workable.com/wk', id) WHEN 6 THEN concat('https://jobs.smartrecruiters.com/Sm', id)
   WHEN 7 THEN concat('https://rc', id, '.recruitee.com/') WHEN 8 THEN concat('https://t', id, '.wd5.myworkdayjobs.com/Ext') WHEN 9 THEN concat('https://wd3.myworkdaysite.com/recruiting/t', id, '/Ext')
   WHEN 10 THEN concat('https://careers-i', id, '.icims.com/jobs') WHEN 11 THEN concat('https://o', id, '.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1') WHEN 12 THEN concat('https://e', id, '.eightfold.ai/careers?domain=e', id, '.org')
   ELSE concat('https://site', id, '.example/Careers?a=1&b=2') END AS page FROM ({_SPELLINGS})""")
def c15(i):
    s = i.sql(_SPELLINGS).select("id", U.resolve_source(F.col("url")).alias("s"))
    return s.select("id", U.board_page_url(F.col("s.adapter"), F.col("s.fetch_url")).alias("page"))


@query("c16_posting_label", f"""
SELECT id, {ox_label()} AS label, concat('New job: ', {ox_label()}) AS added, concat('Job updated: ', {ox_label()}, ' (title, url)') AS updated FROM ox_titles""")
def c16(i):
    t, loc, none = F.col("title"), F.col("location"), F.array().cast("array<string>")
    return i.sql(TITLES).select(
        "id", X.posting_label(t, loc).alias("label"), X.event_summary(F.lit("JOB_ADDED"), t, loc, none).alias("added"),
        X.event_summary(F.lit("JOB_UPDATED"), t, loc, F.array(F.lit("title"), F.lit("url"))).alias("updated"))


_SLUGS = """SELECT p_partkey AS id, concat(replace(p_name, ' ', '-'), CASE p_partkey % 4 WHEN 0 THEN '---remote' WHEN 1 THEN '-iii' WHEN 2 THEN '-r%26d' ELSE '--x' END) AS slug FROM part"""
_CAP = "concat(upper(left({0}, 1)), substr({0}, 2))"


@query("c19_title_from_slug", f"""
WITH w AS (SELECT p_partkey AS id, p_partkey % 4 AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), c AS (SELECT *, concat({_CAP.format('a')}, ' ', {_CAP.format('b')}) AS n, concat(a, ' ', b) AS low FROM w)
SELECT id, concat(n, CASE k WHEN 0 THEN ' - Remote' WHEN 1 THEN ' Iii' WHEN 2 THEN ' R&D' ELSE ' X' END) AS icims,
       concat(n, CASE k WHEN 0 THEN ' Remote' WHEN 1 THEN ' III' WHEN 2 THEN ' R&d' ELSE ' X' END) AS google,
       concat(low, CASE k WHEN 0 THEN ' remote' WHEN 1 THEN ' iii' WHEN 2 THEN ' r&d' ELSE ' x' END) AS successfactors FROM c""")
def c19(i):
    return i.sql(_SLUGS).select("id", *[U.title_from_slug(F.col("slug"), s).alias(s) for s in ("icims", "google", "successfactors")])


@query("d01_dedupe_boards", f"""
SELECT DISTINCT adapter, fetch_url AS url, lower(regexp_extract(fetch_url, '^https://([^/?]+)', 1)) AS host FROM ({_RESOLVED})""")
def d01(i):
    one = i.sql(_SPELLINGS)
    again = one.withColumn("url", F.concat("url", F.lit("#again")))
    return dedupe_boards(one.unionByName(again))
