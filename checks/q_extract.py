"""B: payloads to postings. Bodies are built from `part`; the SQL says what they were built from."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import payloads as Y
from checks.registry import query, spread
from checks.views import ox_remote, ox_seniority
from jobdelta.operators import extract as X

NAMES = {
    "greenhouse": "b01", "lever": "b02", "ashby": "b03", "workable": "b04", "smartrecruiters": "b05", "recruitee": "b06", "workday": "b07",
    "icims": "b08", "apple": "b09", "google": "b10", "amazon": "b11", "microsoft": "b12", "oracle": "b13", "eightfold": "b14",
    "successfactors": "b15", "html": "b17",
}
SHOWN = ["resource_id", "location", "department", "company", "url", "posted_at", "others", "annual_min", "annual_max", "currency", "period", "years", "partial", "title", "key"]
#: What the SQL derives from the columns that every platform has.
DERIVED = f"{ox_remote('title', 'location')} AS remote, {ox_seniority('title')} AS seniority"


def payloads(i, adapter):
    p = spread(i.sql(Y.payload_sql(adapter)))
    return p.unionByName(i.sql(Y.ICIMS_SEARCH)) if adapter == "icims" else p


def companies(i):
    return i.sql("""SELECT concat('o', p_partkey DIV 350, '.fa.oraclecloud.com') AS host, concat('Oracle user ', p_partkey DIV 350) AS company FROM part WHERE p_partkey DIV 350 % 2 = 0 GROUP BY 1, 2
        UNION ALL SELECT concat('jobs.sf', p_partkey DIV 60, '.example'), concat('Sf ', p_partkey DIV 60) FROM part WHERE p_partkey DIV 60 % 2 = 0 GROUP BY 1, 2""")


def shown(df):
    return df.select("resource_id", "key", "title", "location", "department", "company", "url", "posted_at",
                     F.array_join("other_locations", "|").alias("others"), "salary.annual_min", "salary.annual_max", "salary.currency", "salary.period",
                     F.col("experience_years").alias("years"), "partial", "remote", "seniority")


def _register(adapter, name):
    # Two JSON-LD postings of one page can share a key made of title and place: the last one stays.
    extra = " QUALIFY row_number() OVER (PARTITION BY resource_id, key ORDER BY last_key DESC) = 1" if adapter == "html" else ""
    body = f"SELECT {', '.join(SHOWN)}, {DERIVED} FROM ({Y.EXPECTED[adapter]}){extra}"

    @query(f"{NAMES[adapter]}_{adapter if adapter != 'html' else 'jsonld'}", body)
    def run(i):
        out, _ = X.extract_postings(payloads(i, adapter), companies(i), [adapter])
        return shown(out)


for _a, _n in NAMES.items():
    _register(_a, _n)


@query("b16_successfactors_sitemap", f"SELECT {', '.join(SHOWN)}, {DERIVED} FROM ({Y.EXPECTED['successfactors_sitemap']})")
def b16(i):
    out, _ = X.extract_postings(i.sql(Y.SF_SITEMAPS), adapters=["successfactors"])
    return shown(out)


# Listing order: a key stands where it was first seen.
@query("b17b_jsonld_order", f"""
SELECT key, annual_min, row_number() OVER (PARTITION BY resource_id ORDER BY last_key) AS nth FROM (
  SELECT resource_id, key, min(last_key) AS last_key, arg_max_null(annual_min, last_key) AS annual_min FROM ({Y.EXPECTED['html']}) GROUP BY 1, 2)""")
def b17b(i):
    out, _ = X.extract_postings(payloads(i, "html"), adapters=["html"])
    nth = F.row_number().over(Window.partitionBy("resource_id").orderBy("ordinal")).cast("bigint")
    return out.select("key", "salary.annual_min", nth.alias("nth"))
