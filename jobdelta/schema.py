"""Schemas and the small parameter tables every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

SALARY = T.StructType([
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("annual_min", T.LongType()),
    T.StructField("annual_max", T.LongType()),
])

POSTING_FIELDS = [
    T.StructField("key", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("posted_at", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("other_locations", T.ArrayType(T.StringType())),
    T.StructField("salary", SALARY),
    T.StructField("experience_years", T.DoubleType()),
    T.StructField("remote", T.BooleanType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("partial", T.BooleanType()),
    T.StructField("ordinal", T.LongType()),
]

#: One row per posting of a board; `ordinal` keeps the listing order of the board.
POSTING = T.StructType([T.StructField("resource_id", T.StringType()), *POSTING_FIELDS])

#: One row per page of a listing, as fetched. `check_id` names the check that fetched it: pages of two checks never mix.
PAYLOAD = T.StructType([
    T.StructField("resource_id", T.StringType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("adapter", T.StringType()),
    T.StructField("fetch_url", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.StringType()),
])

# The levels, pay periods and change types of the data model.
SENIORITIES = ["intern", "entry", "mid", "senior", "staff", "principal", "manager", "director"]
PERIODS = ["year", "month", "week", "day", "hour"]
PER_YEAR = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}
PAY_BOUNDS = {
    "year": (10_000, 5_000_000),
    "month": (500, 400_000),
    "week": (200, 100_000),
    "day": (40, 20_000),
    "hour": (5, 1_000),
}
JOB_ADDED, JOB_REMOVED, JOB_UPDATED = "JOB_ADDED", "JOB_REMOVED", "JOB_UPDATED"
CHANGE_TYPES = [JOB_ADDED, JOB_REMOVED, JOB_UPDATED]
TRACKED_FIELDS = ["title", "location", "department", "url"]
PLATFORMS = [
    "greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "workday", "icims",
    "apple", "google", "amazon", "microsoft", "oracle", "eightfold", "successfactors",
]
#: How many of its newest postings a platform shows per board, where the listing is a window.
WINDOW_CAPS = {
    "workday": 200, "apple": 300, "amazon": 300, "oracle": 300,
    "successfactors": 200, "eightfold": 50, "microsoft": 50,
}
