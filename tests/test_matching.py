import random
import re

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from helpers import posting, postings
from jobdelta.functions import text as X
from jobdelta.operators import filters as L
from jobdelta.operators import search as S
from jobdelta.operators.delivery import page_changes
from jobdelta.operators.percolate import percolate

TERMS = [
    ("senior ios engineer", "ios", True), ("two studios", "ios", False), ("javascript developer", "java", False),
    ("java developer", "java", True), ("c++ engineer", "c++", True), ("c engineer", "c++", False), ("work on asp.net", ".net", False),
    ("senior .net dev", ".net", True), ("in new york, ny", "new york", True), ("newyork", "new york", False),
    ("ios engineers", "ios engineer", True), ("boss of buses", "bus", True), ("manager/lead", "manager", True),
    ("señor or not", "or", True), ("données", "es", False), ("(remote)", "remote", True), ("a & b", "&", True),
]


def test_term_match(rows):
    got = rows("text string, term string", [t[:2] for t in TERMS]).select("text", "term", X.term_match(F.col("text"), F.col("term")).alias("hit"))
    assert {(r.text, r.term): r.hit for r in got.collect()} == {t[:2]: t[2] for t in TERMS}


@pytest.mark.parametrize("title,level", [
    ("Senior Engineering Manager", "manager"), ("Staff Engineer", "staff"), ("Sr. Engineer", "senior"), ("Engineer III", "senior"),
    ("Engineer I", "entry"), ("Engineer II", "mid"), ("VP, Sales", "director"), ("Solutions Architect", "principal"),
    ("International Lawyer", "mid"), ("Internship", "intern"), ("Staffing Lead", "senior"), ("New Grad Engineer", "entry")])
def test_seniority(rows, title, level):
    assert rows("t string", [(title,)]).select(X.seniority(F.col("t"))).first()[0] == level


@pytest.mark.parametrize("title,place,remote", [
    ("Dev", "Remote, US", True), ("Dev", "Hybrid remote", False), ("Dev (on-site)", "Remote", False), ("Not remote dev", None, False),
    ("WFH dev", None, True), ("Dev", "Oslo", False)])
def test_remote(rows, title, place, remote):
    assert rows("t string, l string", [(title, place)]).select(X.is_remote(F.col("t"), F.col("l"))).first()[0] is remote


def salary(lo=None, hi=None, currency="USD"):
    return (lo, hi, currency, "year", int(lo) if lo else None, int(hi) if hi else None)


JOB = posting("r", "k", "Senior iOS Engineer", location="Austin, TX", other_locations=["Oslo", "Lima"], department="Mobile",
              company="Acme", salary=salary(100_000.0, 150_000.0), experience_years=4.0, seniority="senior")


@pytest.mark.parametrize("filters,passes", [
    ({}, True), ({"keywords": ["ios", "go"]}, True), ({"keywords": ["go"]}, False), ({"all_keywords": ["ios", "mobile"]}, True),
    ({"all_keywords": ["ios", "go"]}, False), ({"exclude_keywords": ["engineer"]}, False), ({"locations": ["lima"]}, True),
    ({"locations": ["rome"]}, False), ({"seniority": ["senior"]}, True), ({"seniority": ["staff"]}, False), ({"remote_only": True}, False),
    ({"min_salary": 150_000}, True), ({"min_salary": 150_001}, False), ({"min_salary": 1, "salary_currency": "EUR"}, False),
    ({"max_experience_years": 4}, True), ({"max_experience_years": 3}, False)])
def test_filters(spark, filters, passes):
    open_ = postings(spark, [JOB])
    assert S.matching(open_, **filters).count() == passes
    cols = L.LISTS + L.OTHERS
    row = [float(v) if v is not None and L.TYPES[c] == "double" else v for c in cols for v in [filters.get(c)]]
    watch = spark.createDataFrame([("w", *row)], "watch_id string, " + ", ".join(f"{c} {L.TYPES[c]}" for c in cols))
    assert S.search_many(open_, watch, 5).count() == passes


@pytest.mark.parametrize("include,passes", [(True, 1), (False, 0)])
def test_unstated_pay_and_years(spark, include, passes):
    bare = postings(spark, [posting("r", "k")])
    assert S.matching(bare, min_salary=10, include_unknown=include).count() == passes
    assert S.matching(bare, max_experience_years=1, include_unknown=include).count() == passes


def test_pay_without_currency_passes_any(spark):
    job = postings(spark, [posting("r", "k", salary=salary(90_000.0, None, None))])
    assert S.matching(job, min_salary=90_000, salary_currency="EUR").count() == 1


def brute(jobs, watches):
    def hit(text, term):
        return re.search(rf"(^|[^\w]|_){re.escape(term)}(s|es)?($|[^\w]|_)", text) is not None

    out = set()
    for j in jobs:
        text = " ".join(x for x in (j["title"], j["location"], j["department"], j["company"]) if x).lower()
        place = f"{j['location'] or ''} {' | '.join(j['other_locations'] or [])}".lower()
        pay = (j["salary"][5] or j["salary"][4]) if j["salary"] else None
        for w in watches:
            if w["resource_id"] and w["resource_id"] != j["resource_id"]:
                continue
            if w["keywords"] and not any(hit(text, k) for k in w["keywords"]):
                continue
            if not all(hit(text, k) for k in w["all_keywords"]) or any(hit(text, k) for k in w["exclude_keywords"]):
                continue
            if w["locations"] and not any(hit(place, k) for k in w["locations"]):
                continue
            if w["seniority"] and j["seniority"] not in w["seniority"] or w["remote_only"] and not j["remote"]:
                continue
            if w["min_salary"] is not None and not (w["include_unknown"] if pay is None else pay >= w["min_salary"]):
                continue
            if w["max_experience_years"] is not None and not (
                    w["include_unknown"] if j["experience_years"] is None else j["experience_years"] <= w["max_experience_years"]):
                continue
            out.add((j["resource_id"], j["key"], w["watch_id"]))
    return out


@pytest.mark.parametrize("seed", [7, 8])
def test_percolation_equals_the_plain_join(spark, seed):
    r = random.Random(seed)
    words = ["ios", "java", "c++", ".net", "engineers", "data", "new york", "buses", "&", "c", "lead", "node.js"]
    jobs = [posting(f"r{r.randrange(4)}", f"k{n}", " ".join(r.choices(words, k=3)).title(), location=r.choice([None, "Oslo", "New York", "Lima (remote)"]),
                    other_locations=r.choice([None, ["Rome", "c++ town"]]), department=r.choice(["", "Data"]), remote=r.random() < .3,
                    seniority=r.choice(["mid", "senior"]), experience_years=r.choice([None, 0.0, 2.5, 7.0]),
                    salary=r.choice([None, salary(50_000.0, 70_000.0), salary(2_000_000.0, None)])) for n in range(120)]
    pick = lambda xs, p: r.sample(xs, r.randrange(1, 3)) if r.random() < p else []
    watches = []
    for n in range(160):
        watches.append({
            "watch_id": f"w{n}", "resource_id": r.choice([None, None, "r1"]), "keywords": pick(["ios", "c++", ".net", "bus", "&", "new york", "engineer", "java", "data lead", "ios c++ data", "lead engineer"], .4),
            "all_keywords": pick(["data", "c", "lead", "node.js", "+"], .2), "exclude_keywords": pick(["java", "lead"], .3), "locations": pick(["oslo", "new york", "c++ town"], .2),
            "seniority": pick(["senior", "staff"], .2), "remote_only": r.random() < .15, "min_salary": r.choice([None, None, 60_000.0, 1_500_000.0]),
            "max_experience_years": r.choice([None, None, 0.0, 3.0]), "include_unknown": r.random() < .5})
    cols = ["watch_id", "resource_id", *L.LISTS, "remote_only", "min_salary", "max_experience_years", "include_unknown"]
    schema = "watch_id string, resource_id string, " + ", ".join(f"{c} {L.TYPES[c]}" for c in cols[2:])
    wdf = spark.createDataFrame([tuple(w[c] for c in cols) for w in watches], schema)
    got = [tuple(x) for x in percolate(S._as_events(postings(spark, jobs)), wdf, carry=["resource_id", "item_key"])
           .select("resource_id", "item_key", "watch_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(jobs, watches)


def test_page_ends_between_ids_and_a_page_of_one_id_is_whole(rows):
    pairs = rows("client_id string, change_id long, watch_id string", [
        ("a", 1, "w1"), ("a", 2, "w1"), ("a", 2, "w2"), ("a", 3, "w1"), ("b", 5, "w3"), ("b", 5, "w4"), ("b", 5, "w5"), ("b", 6, "w3"), ("c", 9, "w9")])
    log = rows("change_id long", [(12,)])
    got = {}
    for r in page_changes(pairs, log, 2).collect():
        got.setdefault(r.client_id, (r.has_more, r.cursor, []))[2].append((r.change_id, r.watch_id))
    assert got["a"][0] is True and got["a"][1] == 1 and got["a"][2] == [(1, "w1")]
    assert got["b"][0] is True and got["b"][1] == 5 and len(got["b"][2]) == 3
    assert got["c"] == (False, 12, [(9, "w9")])


def test_normalised_values_agree_with_columns(spark):
    given = {"keywords": [" A ", "a", "B"] + [f"t{n}" for n in range(30)], "min_salary": 0.4, "salary_currency": "usd", "max_experience_years": 99.0,
             "seniority": ["boss", "mid"], "include_unknown": None}
    df = spark.createDataFrame([tuple(given.get(c) for c in L.LISTS + L.OTHERS)], ", ".join(f"{c} {L.TYPES[c]}" for c in L.LISTS + L.OTHERS))
    assert L.normalize_filters(df).first().asDict() == L.normalize_values(**given)


def test_unread_starts_below_the_join(spark):
    """Changes that every watch has read are filtered before the join, and no watch sees one below its own cursor."""
    from jobdelta.operators.delivery import unread

    jobs = S._as_events(postings(spark, [posting("r1", f"k{n}", "Java Engineer") for n in range(30)])).withColumn("change_id", F.substring("item_key", 2, 9).cast("bigint"))
    watches = spark.createDataFrame([("w1", "c", None, ["java"], 10, 0, None), ("w2", "c", "r1", ["engineer"], 20, 0, None), ("w3", "c", None, ["java"], 0, 0, "gone")],
                                    "watch_id string, client_id string, resource_id string, keywords array<string>, cursor_id long, baseline long, deleted_at string")
    out = unread(jobs, watches)
    assert sorted((r.watch_id, r.change_id) for r in out.collect()) == [("w1", n) for n in range(11, 30)] + [("w2", n) for n in range(21, 30)]
    assert {"job", "summary"} & set(out.columns) <= {"job"} and "_floor" not in out.columns


def test_deleted_watches_stay_where_they_are(spark):
    from jobdelta.operators.delivery import ack, advance

    watches = spark.createDataFrame([("w1", "c", 5, None), ("w2", "c", 5, "gone")], "watch_id string, client_id string, cursor_id long, deleted_at string")
    moved = advance(watches, spark.createDataFrame([("c", 9)], "client_id string, cursor long"))
    assert {r.watch_id: r.cursor_id for r in moved.collect()} == {"w1": 9, "w2": 5}
    log = spark.createDataFrame([(20,)], "change_id long")
    acked = ack(watches, spark.createDataFrame([("c", None, 12), ("c", "w2", 13)], "client_id string, watch_id string, cursor long"), log)
    assert {r.watch_id: r.cursor_id for r in acked.collect()} == {"w1": 12, "w2": 5}


def test_filters_are_not_cut(spark):
    words = [f"t{n}" for n in range(50)]
    given = L.normalize_values(keywords=words, min_salary=4e9, max_experience_years=75)
    assert given["keywords"] == words and given["min_salary"] == L.TOP and given["max_experience_years"] == 75
    with pytest.raises(ValueError):
        S.search_open(postings(spark, [posting("r", "a")]), limit=0)
    many = postings(spark, [posting("r", f"k{n}", "Java") for n in range(150)])
    assert S.search_open(many, limit=140, keywords=["java"]).count() == 140


def test_unread_rows_are_shaped_before_they_are_handed_out(spark):
    """What a row shows of its change is worked out once per change and class, below the join that hands rows to searches."""
    plan = __spark_entry__.queries()["f01_unread"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top, below = plan.split("Join", 1)
    assert "date_format" in below and "date_format" not in top
