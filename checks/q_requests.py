"""E3-E5: requests built from known choices must read back into those choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, spread
from checks.views import ORACLE_VIEWS
from jobdelta.functions.request_words import place_aliases
from jobdelta.operators import requests as R

_K = "c_custkey"
REQUESTS = f"""SELECT {_K} AS id, concat(CASE {_K} % 4 WHEN 0 THEN 'Hey, use jobhound.io to find ' WHEN 1 THEN 'can you show the current ' WHEN 2 THEN 'See https://x.example/a?b=1 and watch ' ELSE '' END,
   CASE {_K} % 7 WHEN 0 THEN 'iOS' WHEN 1 THEN 'iOS or Android' WHEN 2 THEN 'Machine learning or Product design' WHEN 3 THEN 'machine learning' WHEN 4 THEN 'senior React engineer' WHEN 5 THEN 'software engineers' ELSE 'entry level .NET developer' END, ' jobs ',
   CASE {_K} % 11 WHEN 0 THEN '' WHEN 1 THEN 'in Austin, TX ' WHEN 2 THEN 'remote ' WHEN 3 THEN 'in SF or NYC ' WHEN 4 THEN 'in the Denver metro area ' WHEN 5 THEN 'in Berlin or remote ' WHEN 6 THEN 'in albany new york ' WHEN 7 THEN 'near seattle wa ' WHEN 8 THEN 'in London, no managers, ' WHEN 9 THEN 'hybrid in Oslo ' ELSE 'fully remote ' END,
   CASE {_K} % 5 WHEN 0 THEN '' WHEN 1 THEN concat('paying at least $', 100 + {_K} % 90, 'k a year ') WHEN 2 THEN concat('making over ', 60 + {_K} % 30, 'k ') WHEN 3 THEN concat('paying £', 40 + {_K} % 20, '/hr ') ELSE 'under $200k ' END,
   CASE {_K} % 3 WHEN 0 THEN concat('with a maximum of ', 2 + {_K} % 8, ' years of experience') WHEN 1 THEN '3-5 yrs experience' ELSE '' END,
   CASE WHEN {_K} % 6 = 0 THEN ', and tell me when new ones appear' ELSE '' END) AS request FROM customer"""
ORACLE_VIEWS["ox_requests"] = f"""SELECT {_K} AS id,
   CASE {_K} % 7 WHEN 0 THEN ['ios'] WHEN 1 THEN ['ios', 'android'] WHEN 2 THEN ['machine learning', 'product design'] WHEN 3 THEN []::VARCHAR[] WHEN 4 THEN ['react'] WHEN 5 THEN ['software engineer'] ELSE ['.net'] END AS keywords,
   CASE {_K} % 7 WHEN 3 THEN ['machine', 'learning'] ELSE []::VARCHAR[] END AS all_keywords, CASE {_K} % 11 WHEN 8 THEN 'manager' ELSE '' END AS exclude_keywords,
   CASE {_K} % 11 WHEN 1 THEN ['austin'] WHEN 3 THEN ['san francisco', 'sf', 'new york', 'nyc'] WHEN 4 THEN ['denver', 'boulder', 'broomfield'] WHEN 5 THEN ['berlin', 'remote'] WHEN 6 THEN ['albany'] WHEN 7 THEN ['seattle'] WHEN 8 THEN ['london'] WHEN 9 THEN ['oslo'] ELSE []::VARCHAR[] END AS locations,
   CASE {_K} % 7 WHEN 4 THEN 'senior' WHEN 6 THEN 'entry' ELSE '' END AS seniority, {_K} % 11 IN (2, 10) AS remote_only,
   CAST(CASE {_K} % 5 WHEN 1 THEN (100 + {_K} % 90) * 1000 WHEN 2 THEN (60 + {_K} % 30) * 1000 WHEN 3 THEN (40 + {_K} % 20) * 2080 END AS INTEGER) AS min_salary,
   CASE {_K} % 5 WHEN 1 THEN 'USD' WHEN 3 THEN 'GBP' END AS salary_currency, CAST(CASE {_K} % 3 WHEN 0 THEN 2 + {_K} % 8 WHEN 1 THEN 5 END AS INTEGER) AS max_experience_years,
   CAST(CASE WHEN {_K} % 5 = 4 THEN 1 ELSE 0 END + CASE WHEN {_K} % 11 = 9 THEN 1 ELSE 0 END AS BIGINT) AS notes FROM customer"""


def _read(i):
    return R.interpret_requests(spread(i.sql(REQUESTS)), "request", service="jobhound")


@query("e03_interpret_requests", """
SELECT id, array_to_string(keywords, ',') AS keywords, array_to_string(all_keywords, ',') AS all_keywords, exclude_keywords, array_to_string(locations, ',') AS locations,
       seniority, remote_only, min_salary, salary_currency, max_experience_years, notes FROM ox_requests""")
def e03(i):
    text = lambda c: F.array_join(c, ",").alias(c)
    return _read(i).select("id", *[text(c) for c in ("keywords", "all_keywords", "exclude_keywords", "locations", "seniority")],
                           "remote_only", "min_salary", "salary_currency", "max_experience_years", F.size("notes").cast("bigint").alias("notes"))


_PLACES = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ' NYC ' WHEN 1 THEN 'bay area' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'UK' ELSE 'SF' END AS place FROM customer"


@query("e04_expand_places", f"""
SELECT DISTINCT id, CASE WHEN lower(trim(place)) IN ('nyc', 'uk', 'sf', 'bay area') THEN unnest(CASE lower(trim(place)) WHEN 'nyc' THEN ['new york', 'nyc'] WHEN 'uk' THEN ['united kingdom', 'uk']
   WHEN 'sf' THEN ['san francisco', 'sf'] WHEN 'bay area' THEN [{', '.join("'" + t + "'" for t in place_aliases()['bay area'])}] ELSE [''] END) ELSE lower(trim(place)) END AS town FROM ({_PLACES})""")
def e04(i):
    rows = [(a, t) for a, towns in place_aliases().items() for t in towns]
    return R.expand_places(i.sql(_PLACES), i.spark.createDataFrame(rows, "alias string, town string"))


@query("e05_request_demand", """
SELECT 'keyword' AS kind, unnest(list_concat(keywords, all_keywords)) AS value, count(*) AS requests FROM ox_requests GROUP BY 2
UNION ALL SELECT 'place', unnest(locations), count(*) FROM ox_requests GROUP BY 2
UNION ALL SELECT 'pay', CAST(min_salary // 25000 * 25000 AS VARCHAR), count(*) FROM ox_requests WHERE min_salary IS NOT NULL GROUP BY 2""")
def e05(i):
    return R.request_demand(_read(i))
