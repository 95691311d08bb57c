"""Input views over the driver tables, and the CTE builder for the comparison SQL.

Every view is written in SQL that Spark and DuckDB both run unchanged.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

# Current postings of 40 boards. Board r7 is incomplete.
VIEWS["fx_now"] = """
SELECT concat('r', p_partkey % 40) AS resource_id,
       CASE WHEN p_partkey % 33 = 0 THEN concat('job:moved:', p_partkey) ELSE concat('job:part:', p_partkey) END AS key,
       concat(CASE p_size % 8 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Junior ' WHEN 3 THEN 'Principal ' ELSE '' END,
              p_name, CASE WHEN p_partkey % 11 = 0 THEN ' Manager' ELSE ' Engineer' END,
              CASE WHEN p_partkey % 13 = 0 THEN ' (revised)' ELSE '' END) AS title,
       concat(p_type, CASE p_partkey % 5 WHEN 0 THEN ', Remote' WHEN 1 THEN ' (hybrid)' ELSE '' END) AS location,
       p_brand AS department, concat('Company ', p_partkey % 40) AS company,
       concat('https://jobs.example/', p_partkey) AS url,
       CASE WHEN p_partkey % 3 = 0 THEN 'jsonld' ELSE 'greenhouse' END AS source,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('2026-10-', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0')) END AS posted_at,
       CASE WHEN p_partkey % 4 <> 1 THEN CAST(60000 + (p_partkey % 200) * 1000 AS BIGINT) END AS annual_min,
       CASE WHEN p_partkey % 4 > 1 THEN CAST(90000 + (p_partkey % 200) * 1000 AS BIGINT) END AS annual_max,
       CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'EUR' ELSE 'USD' END END AS currency,
       CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size % 12 AS DOUBLE) END AS experience_years,
       false AS partial, p_partkey % 40 <> 7 AS complete, p_partkey AS ordinal
  FROM part WHERE p_partkey % 7 <> 0
"""

# Every part as an open posting, also those that fx_now leaves out so that a diff has removals.
VIEWS["fx_open"] = VIEWS["fx_now"].replace("WHERE p_partkey % 7 <> 0", "")

# Previous snapshot of the same boards. Board r9 has none (baseline,
VIEWS["fx_prev"] = """
SELECT concat('r', p_partkey % 40) AS resource_id, concat('job:part:', p_partkey) AS key,
       concat(CASE p_size % 8 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Junior ' WHEN 3 THEN 'Principal ' ELSE '' END,
              p_name, CASE WHEN p_partkey % 11 = 0 THEN ' Manager' ELSE ' Engineer' END) AS title,
       CASE WHEN p_partkey % 17 <> 0 THEN concat(p_type, CASE p_partkey % 5 WHEN 0 THEN ', Remote' WHEN 1 THEN ' (hybrid)' ELSE '' END) END AS location,
       p_brand AS department, concat('Company ', p_partkey % 40) AS company,
       concat('https://jobs.example/', p_partkey) AS url,
       CASE WHEN p_partkey % 3 = 0 THEN 'jsonld' ELSE 'greenhouse' END AS source,
       p_partkey % 17 = 0 AS partial, p_partkey AS ordinal
  FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 40 <> 9
"""

# Saved searches. Odd ids watch one board, even ids every board (NULL resource_id).
VIEWS["fx_watches"] = """
SELECT concat('w', c_custkey) AS watch_id, concat('c', c_custkey % 100) AS client_id,
       CASE WHEN c_custkey % 2 = 1 THEN concat('r', c_custkey % 40) END AS resource_id,
       split(CASE c_custkey % 4 WHEN 0 THEN 'ring,gear' WHEN 1 THEN 'widget' WHEN 2 THEN 'bolt' ELSE 'engineer' END, ',') AS keywords,
       split(CASE WHEN c_custkey % 5 = 0 THEN 'manager' ELSE 'zzz' END, ',') AS exclude_keywords,
       c_custkey % 7 = 0 AS remote_only,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(100000 + (c_custkey % 10) * 10000 AS INT) END AS min_salary,
       CASE WHEN c_custkey % 6 = 0 THEN 'USD' END AS salary_currency,
       CASE WHEN c_custkey % 4 = 2 THEN 6 END AS max_experience_years,
       c_custkey % 8 <> 0 AS include_unknown,
       CAST(c_custkey % 50 AS BIGINT) AS baseline, CAST(c_custkey % 300 AS BIGINT) AS cursor_id
  FROM customer
"""

# Usage log, 30 days of January 2024; use today = DATE 2024-01-30.
VIEWS["fx_usage_events"] = """
SELECT event_id, ts, concat('c', user_id) AS client_id, event_type AS tool,
       CASE WHEN event_id % 3 = 0 THEN 'rest' ELSE 'mcp' END AS via
  FROM events
"""

# Clients with first-seen time and source.
VIEWS["fx_clients"] = """
SELECT concat('c', user_id) AS client_id, min(ts) AS created_at,
       CASE WHEN user_id % 6 <> 0 THEN concat('src', user_id % 5) END AS source
  FROM events GROUP BY user_id
"""

# Board check log.
VIEWS["fx_check_log"] = """
SELECT event_id AS check_id, concat('r', user_id % 40) AS resource_id, ts AS checked_at, value / 20 AS seconds,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'changed' WHEN 'signup' THEN 'not_modified' ELSE 'unchanged' END AS outcome,
       CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'ACCESS_DENIED' WHEN 2 THEN 'HTTP_500' ELSE 'TIMEOUT' END END AS code
  FROM events
"""

# Boards.
# The same searches as their owners see them: some deleted, each with a label and a hook.
VIEWS["fx_owned"] = """
SELECT *, CASE WHEN CAST(substr(watch_id, 2) AS INT) % 13 = 0 THEN DATE '2026-10-01' END AS deleted_at,
       concat('Search ', watch_id) AS label, concat('https://hook.example/', client_id) AS webhook_url FROM fx_watches
"""

VIEWS["fx_boards"] = """
SELECT concat('r', s_suppkey) AS resource_id, concat('https://host', s_suppkey % 15, '.example/board/', s_suppkey) AS url,
       concat('host', s_suppkey % 15, '.example') AS host,
       CASE WHEN s_suppkey % 3 = 0 THEN 'html' ELSE 'greenhouse' END AS adapter,
       s_suppkey % 4 = 0 AS indexed,
       CASE WHEN s_suppkey % 8 = 0 THEN 'watched' WHEN s_suppkey % 4 = 0 THEN 'directory' END AS index_origin,
       CAST(s_suppkey % 12 AS INT) AS consecutive_failures
  FROM supplier
"""

# Posting text with pay and years, and with decoys.
VIEWS["fx_pay_text"] = """
SELECT o_orderkey AS id,
       concat('We build tools. ', CASE o_orderkey % 4 WHEN 0 THEN concat('Salary: $', CAST(60000 + o_orderkey % 90 * 1000 AS STRING), ' - $', CAST(90000 + o_orderkey % 90 * 1000 AS STRING), ' per year. ')
                WHEN 1 THEN concat('Pay: $', CAST(20 + o_orderkey % 60 AS STRING), ' - $', CAST(30 + o_orderkey % 60 AS STRING), ' per hour. ')
                WHEN 2 THEN 'Processing $20M a year. ' ELSE '' END,
              CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(1 + o_orderkey % 12 AS STRING), '+ years of experience.') WHEN 1 THEN 'Founded 10 years ago.' ELSE '' END) AS text
  FROM orders
"""

# Crawled pages with a board link and JSON-LD injected (the raw pages have neither).
VIEWS["fx_pages"] = """
SELECT page_id, url,
       concat(html, '<a href="https://boards.greenhouse.io/acme', page_id % 20, '">jobs</a>',
              '<script type="application/ld+json">{"@type":"JobPosting","title":"Role ', page_id, '","identifier":"J', page_id, '"}</script>') AS html
  FROM pages
"""

# Bench postings: as many rows as lineitem (600 000 at sf0.1). D,
VIEWS["fx_big"] = """
SELECT concat('r', l_suppkey % 400) AS resource_id, concat('job:li:', l_orderkey, ':', l_linenumber) AS key,
       concat(p_name, ' Engineer') AS title, p_type AS location, p_brand AS department,
       concat('Company ', l_suppkey % 400) AS company, l_shipdate AS posted_ts
  FROM lineitem JOIN part ON p_partkey = l_partkey
"""


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def run_sql(spark, sf_dir: str, body: str):
    """Run SQL over the tables of `sf_dir` and the views above; only the tables it names are opened."""
    text = with_views(body, VIEWS)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def with_views(body: str, views: dict[str, str] | None = None) -> str:
    """Prefix `body` with the views it names, directly or through another view."""
    views = {**VIEWS, **ORACLE_VIEWS} if views is None else views
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b(?:fx|ox)_\w+", text):
            if word in views and word not in needed:
                visit(views[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    ctes = ", ".join(f"{n} AS ({views[n].strip()})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


#: Views only the comparison SQL uses (DuckDB dialect).
ORACLE_VIEWS: dict[str, str] = {}

_NB, _NE = "(^|[^A-Za-z0-9_])", "($|[^A-Za-z0-9_])"


def ox_seniority(title: str) -> str:
    words = [
        ("intern", "intern|internship|co-op|coop|working student|apprentice"),
        ("director", "director|vp|vice president|chief|head of|cto|cfo|ceo|coo|president"),
        ("manager", "manager|mgr|supervisor"),
        ("principal", "principal|distinguished|fellow|architect"),
        ("staff", "staff"), ("senior", "senior|sr|lead|iii|iv"),
        ("entry", r"junior|jr|entry[\s-]level|new grad|new graduate|graduate|associate|trainee|i"),
    ]
    whens = " ".join(f"WHEN regexp_matches({title}, '(?i){_NB}({w}){_NE}') THEN '{n}'" for n, w in words)
    return f"CASE {whens} ELSE 'mid' END"


def ox_remote(title: str, location: str) -> str:
    text = f"concat({title}, ' ', coalesce({location}, ''))"
    yes = rf"(?i){_NB}(remote|telecommute|telework|work from home|wfh|anywhere){_NE}"
    no = rf"(?i){_NB}(no|not|non)[\s-]*(remote|telework|telecommute)|{_NB}on[\s-]?site{_NE}|{_NB}hybrid{_NE}"
    return f"(regexp_matches({text}, '{yes}') AND NOT regexp_matches({text}, '{no}'))"


def ox_search_text(p: str = "") -> str:
    return "lower(concat_ws(' ', " + ", ".join(f"nullif({p}{c}, '')" for c in ("title", "location", "department", "company")) + "))"


def ox_term(text: str, term: str) -> str:
    return rf"regexp_matches({text}, concat('(^|[^\p{{L}}\p{{N}}])', regexp_escape({term}), '(s|es)?($|[^\p{{L}}\p{{N}}])'))"


def ox_label(p: str = "") -> str:
    return f"concat({p}title, CASE WHEN coalesce({p}location, '') <> '' THEN concat(' (', {p}location, ')') ELSE '' END)"


ORACLE_VIEWS["ox_now"] = f"""
SELECT *, {ox_remote('title', 'location')} AS remote, {ox_seniority('title')} AS seniority,
       {ox_search_text()} AS search_text, concat(lower(coalesce(location, '')), ' ') AS location_text,
       coalesce(annual_max, annual_min) AS pay
  FROM fx_open"""

# The difference of fx_prev and fx_now before any suppression.
ORACLE_VIEWS["ox_both"] = """
SELECT coalesce(a.resource_id, b.resource_id) AS resource_id, coalesce(a.key, b.key) AS key,
       a.key AS a_key, b.key AS b_key, a.title AS a_title, b.title AS b_title,
       a.location AS a_location, b.location AS b_location, a.department AS a_department, b.department AS b_department,
       a.url AS a_url, b.url AS b_url, a.company AS a_company, b.company AS b_company,
       a.source AS a_source, b.source AS b_source, a.partial AS a_partial, b.partial AS b_partial,
       a.ordinal AS a_ordinal, b.ordinal AS b_ordinal, c.complete
  FROM fx_now a FULL OUTER JOIN fx_prev b ON a.resource_id = b.resource_id AND a.key = b.key
  JOIN (SELECT resource_id, bool_and(complete) AS complete FROM fx_now GROUP BY 1) c
    ON c.resource_id = coalesce(a.resource_id, b.resource_id)
 WHERE coalesce(a.resource_id, b.resource_id) IN (SELECT resource_id FROM fx_prev)"""

_FIELDS = """list_filter([CASE WHEN {b}title IS DISTINCT FROM {a}title THEN 'title' END,
  CASE WHEN {b}location IS DISTINCT FROM {a}location THEN 'location' END,
  CASE WHEN {b}department IS DISTINCT FROM {a}department THEN 'department' END,
  CASE WHEN {b}url IS DISTINCT FROM {a}url THEN 'url' END], lambda x: x IS NOT NULL)"""

ORACLE_VIEWS["ox_pairs"] = f"""
SELECT r.resource_id, r.b_key, a.a_key, r.b_ordinal, a.a_title AS title, a.a_location AS location,
       a.a_department AS department, a.a_company AS company, a.a_url AS url,
       {_FIELDS.format(a='a.a_', b='r.b_')} AS changed_fields,
       coalesce(r.b_partial, false) AND NOT coalesce(a.a_partial, false) AS enriched
  FROM (SELECT resource_id, lower(trim(coalesce(b_title, ''))) AS t, lower(trim(coalesce(b_company, ''))) AS c,
               any_value(b_key) AS b_key, any_value(b_ordinal) AS b_ordinal, any_value(b_title) AS b_title,
               any_value(b_location) AS b_location, any_value(b_department) AS b_department, any_value(b_url) AS b_url,
               any_value(b_partial) AS b_partial
          FROM ox_both WHERE a_key IS NULL AND b_source = 'jsonld' GROUP BY 1, 2, 3 HAVING count(*) = 1) r
  JOIN (SELECT resource_id, lower(trim(coalesce(a_title, ''))) AS t, lower(trim(coalesce(a_company, ''))) AS c,
               any_value(a_key) AS a_key, any_value(a_title) AS a_title, any_value(a_location) AS a_location,
               any_value(a_department) AS a_department, any_value(a_url) AS a_url, any_value(a_company) AS a_company,
               any_value(a_partial) AS a_partial
          FROM ox_both WHERE b_key IS NULL AND a_source = 'jsonld' GROUP BY 1, 2, 3 HAVING count(*) = 1) a
    ON r.resource_id = a.resource_id AND r.t = a.t AND r.c = a.c"""

ORACLE_VIEWS["ox_drafts"] = f"""
SELECT resource_id, 'JOB_ADDED' AS type, a_key AS item_key, a_title AS title, a_location AS location,
       a_department AS department, a_company AS company, NULL::VARCHAR[] AS changed_fields, 0 AS type_rank, a_ordinal AS position
  FROM ox_both WHERE b_key IS NULL AND (resource_id, a_key) NOT IN (SELECT resource_id, a_key FROM ox_pairs)
UNION ALL
SELECT resource_id, 'JOB_REMOVED', b_key, b_title, b_location, b_department, b_company, NULL, 1, b_ordinal
  FROM ox_both WHERE a_key IS NULL AND complete AND (resource_id, b_key) NOT IN (SELECT resource_id, b_key FROM ox_pairs)
UNION ALL
SELECT resource_id, 'JOB_UPDATED', a_key, a_title, a_location, a_department, a_company, changed, 2, a_ordinal
  FROM (SELECT *, {_FIELDS.format(a='a_', b='b_')} AS changed FROM ox_both WHERE a_key IS NOT NULL AND b_key IS NOT NULL)
 WHERE len(changed) > 0 AND NOT (coalesce(b_partial, false) AND NOT coalesce(a_partial, false))
UNION ALL
SELECT resource_id, 'JOB_UPDATED', a_key, title, location, department, company, changed_fields, 3, b_ordinal
  FROM ox_pairs WHERE NOT enriched"""

ORACLE_VIEWS["ox_events"] = f"""
SELECT *, {ox_search_text()} AS search_text,
       CASE type WHEN 'JOB_ADDED' THEN concat('New job: ', {ox_label()})
                 WHEN 'JOB_REMOVED' THEN concat('Job removed: ', {ox_label()})
                 ELSE concat('Job updated: ', {ox_label()}, ' (', array_to_string(changed_fields, ', '), ')') END AS summary
  FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY type_rank, position, item_key) AS event_no FROM ox_drafts)"""

ORACLE_VIEWS["ox_changes"] = """
SELECT row_number() OVER (ORDER BY substr(md5(resource_id), 1, 3), resource_id, event_no) AS change_id, * FROM ox_events"""


def ox_hits(text: str) -> str:
    """Which of the terms of fx_watches a text matches."""
    tests = ", ".join(f"CASE WHEN {ox_term_const(text, t)} THEN '{t}' END" for t in
                      ("ring", "gear", "widget", "bolt", "engineer", "manager", "zzz"))
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def ox_term_const(text: str, term: str) -> str:
    return rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}]){term}(s|es)?($|[^\p{{L}}\p{{N}}])')"


def ox_passes(p: str = "p.", w: str = "w.") -> str:
    """The filter predicate of fx_watches against a posting row that lists its matched terms as `hits`."""
    return f"""list_has_any({p}hits, {w}keywords) AND NOT list_has_any({p}hits, {w}exclude_keywords)
      AND (NOT {w}remote_only OR {p}remote)
      AND ({w}min_salary IS NULL OR CASE WHEN {p}pay IS NULL THEN {w}include_unknown
           ELSE {p}pay >= {w}min_salary AND ({w}salary_currency IS NULL
                OR coalesce({p}currency, {w}salary_currency) = {w}salary_currency) END)
      AND ({w}max_experience_years IS NULL OR CASE WHEN {p}experience_years IS NULL THEN {w}include_unknown
           ELSE {p}experience_years <= {w}max_experience_years END)"""


# Change rows with the posting columns filters read.
ORACLE_VIEWS["ox_change_jobs"] = f"""
SELECT c.change_id, c.resource_id, c.type, c.item_key, c.title, c.search_text, c.summary,
       CASE WHEN c.type = 'JOB_REMOVED' THEN {ox_remote('c.title', 'c.location')} ELSE n.remote END AS remote,
       n.pay, n.currency, n.experience_years, n.posted_at, c.company, c.location, n.url,
       {ox_hits('c.search_text')} AS hits
  FROM ox_changes c LEFT JOIN ox_now n ON c.type <> 'JOB_REMOVED' AND n.resource_id = c.resource_id AND n.key = c.item_key"""

ORACLE_VIEWS["ox_open_jobs"] = f"""
SELECT n.*, {ox_hits('n.search_text')} AS hits FROM ox_now n"""

ORACLE_VIEWS["ox_seen"] = f"""
SELECT p.*, w.watch_id, w.client_id, w.baseline, w.cursor_id, w.resource_id AS w_resource_id
  FROM ox_change_jobs p JOIN fx_watches w
    ON ((w.resource_id = p.resource_id) OR (w.resource_id IS NULL AND p.type = 'JOB_ADDED'))
   AND {ox_passes()}"""

# A change log with many rows: every current posting as one change.
ORACLE_VIEWS["ox_log"] = f"""
SELECT ordinal + 1 AS change_id, concat('k', ordinal % 97) AS check_id, TIMESTAMP '2026-10-01 00:00:00' + INTERVAL 1 SECOND * (ordinal % 97) AS detected_at,
       resource_id, CASE ordinal % 5 WHEN 0 THEN 'JOB_REMOVED' WHEN 1 THEN 'JOB_UPDATED' ELSE 'JOB_ADDED' END AS type,
       key AS item_key, title, company, location, concat('Posting ', title) AS summary, search_text, remote, pay, annual_min, annual_max,
       currency, experience_years, hits
  FROM ox_open_jobs"""
ORACLE_VIEWS["ox_log_seen"] = f"""
SELECT p.*, w.watch_id, w.client_id, w.baseline, w.cursor_id, w.resource_id AS w_resource_id
  FROM ox_log p JOIN fx_watches w
    ON ((w.resource_id = p.resource_id) OR (w.resource_id IS NULL AND p.type = 'JOB_ADDED'))
   AND {ox_passes()}"""
