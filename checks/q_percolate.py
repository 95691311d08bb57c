"""E: filters, matching, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, spread
from checks.shapes import changes, postings
from checks.views import ORACLE_VIEWS, ox_passes, ox_term
from jobdelta.operators import counters
from jobdelta.operators import filters as L
from jobdelta.operators import percolate as P
from jobdelta.operators import search as S
from jobdelta.operators.snapshot import posting_delta
from jobdelta.session import materialize, scratch_path
from jobdelta.sources import search_index as X

# Messy filters: padding, mixed case, repeats, blanks, more than 20 terms, unknown levels, odd numbers.
MESSY = """SELECT concat('w', c_custkey) AS watch_id,
  split(concat(' Ring,GEAR, ring ,,', c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN
    ',a1,a2,a3,a4,a5,a6,a7,a8,a9,a10,a11,a12,a13,a14,a15,a16,a17,a18,a19,a20,a21' ELSE '' END), ',') AS keywords,
  split(CASE c_custkey % 3 WHEN 0 THEN 'senior,boss,senior' WHEN 1 THEN 'staff,intern' ELSE 'nobody' END, ',') AS seniority,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal * 20000 END AS min_salary,
  CASE c_custkey % 4 WHEN 1 THEN ' usd ' WHEN 2 THEN 'dollars' WHEN 3 THEN 'EUR' END AS salary_currency,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 90 + 0.5 END AS max_experience_years,
  CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS include_unknown
  FROM customer"""

_MESSY_TERMS = f"""SELECT watch_id, string_agg(t, ',' ORDER BY o) AS keywords FROM (
    SELECT watch_id, t, min(o) AS o, row_number() OVER (PARTITION BY watch_id ORDER BY min(o)) AS rn FROM (
      SELECT watch_id, lower(trim(unnest(keywords))) AS t, unnest(range(len(keywords))) AS o FROM m) WHERE t <> '' GROUP BY 1, 2)
  GROUP BY 1"""
_MESSY_PAY = "CASE WHEN min_salary >= 0 THEN CAST(nullif(least(floor(min_salary + 0.5), 2147483647), 0) AS INTEGER) END"


@query("e01_normalize_filters", f"""
WITH m AS ({MESSY}), k AS ({_MESSY_TERMS})
SELECT m.watch_id, k.keywords,
       CASE WHEN m.seniority[1] = 'senior' THEN 'senior' WHEN m.seniority[1] = 'staff' THEN 'staff,intern' ELSE '' END AS seniority,
       {_MESSY_PAY} AS min_salary,
       CASE WHEN {_MESSY_PAY} IS NOT NULL AND trim(salary_currency) <> 'dollars' THEN upper(trim(salary_currency)) END AS salary_currency,
       CAST(CASE WHEN max_experience_years IS NOT NULL THEN floor(max_experience_years + 0.5) END AS INTEGER) AS max_experience_years,
       coalesce(include_unknown, true) AS include_unknown, false AS remote_only
  FROM m JOIN k USING (watch_id)""")
def e01(i):
    return L.normalize_filters(i.sql(MESSY)).select(
        "watch_id", F.array_join("keywords", ",").alias("keywords"), F.array_join("seniority", ",").alias("seniority"),
        "min_salary", "salary_currency", "max_experience_years", "include_unknown", "remote_only")


# What a request said, and what the caller passed explicitly, as separate columns.
SAID = """SELECT concat('w', c_custkey) AS watch_id,
  CASE WHEN c_custkey % 3 = 1 THEN 'gear' END AS e_key, CASE WHEN c_custkey % 5 = 1 THEN 'bolt' END AS e_all,
  CASE WHEN c_custkey % 2 = 0 THEN 'widget' END AS r_key, CASE WHEN c_custkey % 4 = 0 THEN 'ring' END AS r_all,
  CASE WHEN c_custkey % 7 = 0 THEN 120000 END AS e_pay, CASE WHEN c_custkey % 3 = 0 THEN 90000 END AS r_pay,
  CASE WHEN c_custkey % 11 = 0 THEN true WHEN c_custkey % 11 = 1 THEN false END AS e_remote, c_custkey % 2 = 0 AS r_remote
  FROM customer"""


@query("e02_merge_filters", f"""
SELECT watch_id, CASE WHEN e_all IS NOT NULL AND e_key IS NULL THEN '' ELSE coalesce(e_key, r_key, '') END AS keywords,
       CASE WHEN e_key IS NOT NULL AND e_all IS NULL THEN '' ELSE coalesce(e_all, r_all, '') END AS all_keywords,
       CAST(coalesce(e_pay, r_pay) AS INTEGER) AS min_salary, coalesce(e_remote, r_remote) AS remote_only FROM ({SAID})""")
def e02(i):
    def side(p):
        one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
        none = F.lit(None).cast("array<string>")
        return F.struct(
            one(f"{p}_key").alias("keywords"), one(f"{p}_all").alias("all_keywords"), none.alias("exclude_keywords"),
            none.alias("locations"), none.alias("seniority"), F.col(f"{p}_remote").alias("remote_only"),
            F.col(f"{p}_pay").cast("double").alias("min_salary"), F.lit(None).cast("string").alias("salary_currency"),
            F.lit(None).cast("double").alias("max_experience_years"), F.lit(None).cast("boolean").alias("include_unknown"))
    said = i.sql(SAID).select("watch_id", side("e").alias("explicit"), side("r").alias("read"))
    return L.merge_filters(said).select(
        "watch_id", F.array_join("keywords", ",").alias("keywords"), F.array_join("all_keywords", ",").alias("all_keywords"),
        "min_salary", "remote_only")


@query("e06_has_criteria", """
SELECT watch_id, (len(k) > 0 OR pay IS NOT NULL OR remote) AS has_criteria FROM (
  SELECT concat('w', c_custkey) AS watch_id, CASE WHEN c_custkey % 3 = 0 THEN ['gear'] ELSE [] END AS k,
         CASE WHEN c_custkey % 5 = 0 THEN 100 END AS pay, c_custkey % 7 = 0 AS remote FROM customer)""")
def e06(i):
    rows = i.customer.select(
        F.concat(F.lit("w"), "c_custkey").alias("watch_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("gear"))).alias("keywords"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(100.0)).alias("min_salary"),
        (F.col("c_custkey") % 7 == 0).alias("remote_only"))
    return L.normalize_filters(rows).select("watch_id", L.has_criteria().alias("has_criteria"))


@query("e07_matches", f"""
SELECT p.resource_id, p.key, w.watch_id, {ox_passes()} AS passes
  FROM ox_open_jobs p JOIN fx_watches w ON w.resource_id = p.resource_id""")
def e07(i):
    tested = L.mark_text(postings(i.fx_open).withColumns(L.match_columns(F.col)))
    # Tested once for all watches that ask for the same thing of the same board.
    watches = P.search_classes(i.fx_watches.filter("resource_id is not null"))
    classes = L.prepare_terms(watches.dropDuplicates(["w_class"])).select("w_class", "resource_id", *[F.col(c).alias(f"w_{c}") for c in L.LISTS + L.OTHERS])
    passed = tested.join(classes, "resource_id").select("w_class", "resource_id", "key", L.matches(lambda c: F.col(f"w_{c}")).alias("passes"))
    return P.hand_out(passed, watches.select("w_class", "watch_id"), ["key"], sizes=(i.fx_open.count(), watches.count())).select("resource_id", "key", "watch_id", "passes")


@query("e08_percolate", """
SELECT change_id, resource_id, type, item_key, watch_id, client_id FROM ox_seen""")
def e08(i):
    return P.percolate(changes(i), i.fx_watches, carry=["change_id", "resource_id", "type", "item_key"]) \
        .select("change_id", "resource_id", "type", "item_key", "watch_id", "client_id")


# Searches without a keyword: filed by location, level, remote, pay or years.
MIXED = """SELECT concat('m', c_custkey) AS watch_id,
  CASE WHEN c_custkey % 6 = 0 THEN split('large,small', ',') END AS locations,
  CASE WHEN c_custkey % 6 = 1 THEN split('staff,principal', ',') END AS seniority,
  c_custkey % 6 = 2 AS remote_only,
  CASE WHEN c_custkey % 6 = 3 THEN 80000 + c_custkey * 150 END AS min_salary,
  CASE WHEN c_custkey % 6 = 4 THEN c_custkey % 12 END AS max_experience_years,
  CASE WHEN c_custkey % 6 = 5 THEN split('engineer,bolt', ',') END AS all_keywords,
  c_custkey % 4 = 0 AS include_unknown FROM customer"""
ORACLE_VIEWS["ox_mixed"] = MIXED
ORACLE_VIEWS["ox_mixed_counts"] = f"""
SELECT m.watch_id, count(p.key) AS matched FROM ox_mixed m JOIN ox_now p ON
       (m.locations IS NULL OR {ox_term('p.location_text', "'large'")} OR {ox_term('p.location_text', "'small'")})
   AND (m.seniority IS NULL OR p.seniority IN ('staff', 'principal')) AND (NOT m.remote_only OR p.remote)
   AND (m.min_salary IS NULL OR CASE WHEN p.pay IS NULL THEN m.include_unknown ELSE p.pay >= m.min_salary END)
   AND (m.max_experience_years IS NULL OR CASE WHEN p.experience_years IS NULL THEN m.include_unknown ELSE p.experience_years <= m.max_experience_years END)
   AND (m.all_keywords IS NULL OR ({ox_term('p.search_text', "'engineer'")} AND {ox_term('p.search_text', "'bolt'")}))
 GROUP BY 1"""


@query("e08b_percolate_without_keywords", "SELECT * FROM ox_mixed_counts")
def e08b(i):
    ev = S._as_events(postings(i.fx_open))
    w = i.sql(MIXED).withColumn("resource_id", F.lit(None).cast("string"))
    return P.count_hits(ev, w).withColumnRenamed("n", "matched")


_GEAR = f"""SELECT resource_id, key, title, posted_at FROM ox_now p
 WHERE ({ox_term('search_text', "'gear'")} OR {ox_term('search_text', "'ring'")})
   AND NOT {ox_term('search_text', "'manager'")} AND (pay IS NULL OR pay >= 90000)"""
GEAR = {"keywords": [" Gear", "ring"], "exclude_keywords": ["manager"], "min_salary": 90000}


@query("e09_search_open", _GEAR + " ORDER BY posted_at DESC NULLS LAST, key LIMIT 25 OFFSET 10")
def e09(i):
    return S.search_open(postings(i.fx_open), limit=25, offset=10, **GEAR).select("resource_id", "key", "title", "posted_at")


@query("e10_search_total", f"""
SELECT count(*) AS total, CAST(10 AS BIGINT) AS "offset", CAST(CASE WHEN 35 < count(*) THEN 35 END AS BIGINT) AS next_offset FROM ({_GEAR})""")
def e10(i):
    return S.search_total(postings(i.fx_open), limit=25, offset=10, **GEAR)


def _indexed(i):
    """An index of the postings before, brought up to date by what differs now, in two updates."""
    path = scratch_path(i.spark, "index")
    now = materialize(spread(postings(i.fx_open)), "postings")  # made once for all listings below
    h = F.pmod(F.xxhash64("key"), F.lit(10))
    before = now.filter(h < 8).withColumn("title", F.when(h == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))
    middle = now.filter((h < 7) | (h == 8))
    X.write_index(before, path, block_docs=2048)
    for old, new in ((before, middle), (middle, now)):
        delta = materialize(posting_delta(old, new), "posting-delta")  # its two sides are read apart
        X.update_index(i.spark, path, delta.filter("sign > 0").drop("sign"), delta.filter("sign < 0"), block_docs=2048)
    return path


@query("e09b_search_index", _GEAR + " ORDER BY posted_at DESC NULLS LAST, key LIMIT 25 OFFSET 10")
def e09b(i):
    return S.page_of(X.indexed_matches(i.spark, _indexed(i), **GEAR), 25, 10).select("resource_id", "key", "title", "posted_at")


@query("e10b_index_total", f"""
SELECT count(*) AS total, CAST(10 AS BIGINT) AS "offset", CAST(CASE WHEN 35 < count(*) THEN 35 END AS BIGINT) AS next_offset FROM ({_GEAR})""")
def e10b(i):
    return S.total_of(X.indexed_matches(i.spark, _indexed(i), **GEAR), 25, 10)


@query("e11_search_many", f"""
SELECT watch_id, rank, resource_id, key, posted_at FROM (
  SELECT w.watch_id, p.resource_id, p.key, p.posted_at,
         row_number() OVER (PARTITION BY w.watch_id ORDER BY p.posted_at DESC NULLS LAST, p.key, p.resource_id) AS rank
    FROM fx_watches w JOIN ox_open_jobs p ON {ox_passes()})
 WHERE rank <= 10""")
def e11(i):
    return S.search_many(postings(i.fx_open), i.fx_watches, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("e12_coverage", """
SELECT count(*) FILTER (resource_id IN (SELECT resource_id FROM fx_open)) AS boards,
       count(*) FILTER (resource_id NOT IN (SELECT resource_id FROM fx_open)) AS boards_awaiting_first_check
  FROM fx_boards b WHERE indexed OR resource_id IN (SELECT resource_id FROM fx_watches WHERE resource_id IS NOT NULL)""")
def e12(i):
    return S.coverage(i.fx_boards, i.fx_watches, i.fx_open)


_BOARDS = "SELECT *, CASE WHEN consecutive_failures > 6 THEN 'HTTP_500' END AS last_error FROM fx_boards"
ORACLE_VIEWS["ox_watch_jobs"] = f"""
SELECT w.watch_id, w.resource_id AS scope_board, p.resource_id, p.key, p.ordinal, p.posted_at
  FROM fx_watches w JOIN ox_open_jobs p ON (w.resource_id IS NULL OR w.resource_id = p.resource_id) AND {ox_passes()}
 WHERE p.resource_id IN (SELECT resource_id FROM fx_boards WHERE indexed OR resource_id IN (SELECT resource_id FROM fx_watches WHERE resource_id IS NOT NULL))"""


@query("e13_watch_status", f"""
SELECT w.watch_id, CASE WHEN w.resource_id IS NULL THEN 'all_boards' ELSE 'board' END AS scope, s.jobs_count,
       coalesce(m.n, 0) AS matching_jobs_count, s.complete,
       CASE WHEN w.resource_id IS NOT NULL THEN coalesce(b.last_error IS NULL AND b.resource_id IS NOT NULL AND s.jobs_count IS NOT NULL, false) END AS healthy
  FROM fx_watches w LEFT JOIN (SELECT watch_id, count(*) AS n FROM ox_watch_jobs GROUP BY 1) m USING (watch_id)
  LEFT JOIN (SELECT resource_id, count(*) AS jobs_count, bool_and(complete) AS complete FROM fx_open GROUP BY 1) s ON s.resource_id = w.resource_id
  LEFT JOIN ({_BOARDS}) b ON b.resource_id = w.resource_id""")
def e13(i):
    return S.watch_status(i.fx_watches, i.sql(_BOARDS), postings(i.fx_open))


@query("e13b_watch_current_jobs", """
SELECT watch_id, rank, resource_id, key FROM (
  SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY CASE WHEN scope_board IS NOT NULL THEN ordinal END,
            CASE WHEN scope_board IS NULL THEN posted_at END DESC NULLS LAST, key, resource_id) AS rank FROM ox_watch_jobs)""")
def e13b(i):
    return S.watch_current_jobs(i.fx_watches, i.sql(_BOARDS), postings(i.fx_open)).withColumn("rank", F.col("rank").cast("bigint"))


_TECH = " OR ".join(ox_term("search_text", f"'{t}'") for t in S.TECH_ROLES)
_NOT_TECH = " OR ".join(ox_term("search_text", f"'{t}'") for t in S.NOT_TECH)


@query("e14_high_pay", f"""
SELECT resource_id, key, title, pay FROM ox_now WHERE ({_TECH}) AND NOT ({_NOT_TECH}) AND pay >= 200000 AND coalesce(currency, 'USD') = 'USD'""")
def e14(i):
    return S.high_pay(postings(i.fx_open), floor=200_000).select(
        "resource_id", "key", "title", F.coalesce("salary.annual_max", "salary.annual_min").alias("pay"))


@query("e14b_preset_label", """
SELECT o_orderkey AS id, concat_ws(' · ', coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 'Tech jobs'),
       CASE WHEN o_orderkey % 2 = 0 THEN 'remote' END, CASE WHEN o_orderkey % 5 = 0 THEN '$300k+' END) AS label FROM orders""")
def e14b(i):
    o = F.col("o_orderkey")
    return i.orders.select(o.alias("id"), S.preset_label(
        F.when(o % 3 > 0, F.col("o_orderpriority")), o % 5 == 0, o % 2 == 0).alias("label"))


_LISTING = """SELECT resource_id, concat('https://boards-api.greenhouse.io/v1/boards/', lower(replace(s_name, '#', '-')), '/jobs') AS url,
    'greenhouse' AS adapter, indexed FROM fx_boards JOIN supplier ON concat('r', s_suppkey) = resource_id"""
_NAMED = """SELECT resource_id, key, CASE WHEN ordinal % 40 % 3 <> 0 THEN company END AS company, ordinal FROM fx_open"""
_COMPANIES = f"""
SELECT b.resource_id, coalesce(p.company, concat('Supplier ', lpad(substr(b.resource_id, 2), 9, '0'))) AS name,
       concat('https://job-boards.greenhouse.io/supplier-', lpad(substr(b.resource_id, 2), 9, '0')) AS board_url,
       'greenhouse' AS platform, p.open_jobs
  FROM ({_LISTING}) b LEFT JOIN (SELECT resource_id, arg_min(company, ordinal) AS company, count(*) AS open_jobs FROM ({_NAMED}) GROUP BY 1) p
    USING (resource_id) WHERE b.indexed"""


def _companies(i):
    return S.companies(i.sql(_LISTING), i.sql(_NAMED))


@query("e15_companies", _COMPANIES)
def e15(i):
    return _companies(i)


@query("e16_find_companies", f"""
SELECT * FROM ({_COMPANIES}) WHERE lower(name) LIKE '%er%' OR lower(board_url) LIKE '%er%' ORDER BY lower(name), board_url LIMIT 8 OFFSET 3""")
def e16(i):
    return S.find_companies(_companies(i), "ER ", limit=8, offset=3)


@query("e17_directory_totals", f"""
SELECT platform, count(*) AS companies, CAST(sum(coalesce(open_jobs, 0)) AS BIGINT) AS open_jobs FROM ({_COMPANIES}) GROUP BY 1""")
def e17(i):
    return S.directory_totals(_companies(i))


@query("e13c_matching_counters", """
SELECT w.watch_id, coalesce(m.n, 0) AS matching FROM fx_watches w LEFT JOIN (SELECT watch_id, count(*) AS n FROM ox_watch_jobs GROUP BY 1) m USING (watch_id)""")
def e13c(i):
    """Counted once, then kept over three batches of boards, equal to a recount."""
    boards, now = i.sql(_BOARDS), postings(i.fx_open)
    was = now.filter("ordinal % 7 <> 0").withColumn("title", F.when(F.col("ordinal") % 11 == 0, F.concat(F.lit("Old "), "title")).otherwise(F.col("title")))
    counts = counters.count_matching(was, i.fx_watches, boards)
    batch = F.pmod(F.xxhash64("resource_id"), F.lit(3))
    for n in range(3):
        counts = materialize(counters.next_matching(counts, was.filter(batch == n), now.filter(batch == n), i.fx_watches, boards), "matching")
    return counts
