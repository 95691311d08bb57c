"""The library's column functions for SQL users, as native SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from jobdelta.functions.agents import client_bucket
from jobdelta.functions.pay import parse_experience, parse_salary
from jobdelta.functions.text import term_match

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')")
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|==|[=<>+\-*/%!]|and|or|in|not)\(")


def _text(value: Column) -> str:
    """A column expression as SQL; operators, which print as function calls, are quoted as such."""
    parts = _LITERAL.split(value._jc.node().sql())
    return "".join(p if n % 2 else _OPERATOR.sub(r"`\1`(", p) for n, p in enumerate(parts))


def register_functions(spark: SparkSession) -> None:
    """`term_match(text, term)`, `parse_salary(text)`, `parse_experience(text)` and `client_bucket(ip)`.

    Each is the column expression itself, so the optimiser sees through it and no Python runs.
    """
    text = F.col("text")
    made = {
        "term_match(text STRING, term STRING)": term_match(text, F.col("term")),
        "parse_salary(text STRING)": parse_salary(text),
        "parse_experience(text STRING)": parse_experience(text),
        "client_bucket(ip STRING)": client_bucket(F.col("ip")),
    }
    for head, value in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN ({_text(value)})")
