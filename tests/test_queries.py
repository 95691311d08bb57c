"""Every registered query agrees with its SQL twin, row for row, on the smallest tables."""

import datetime
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from checks import load
from checks.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, Decimal) else v.isoformat() if isinstance(v, datetime.datetime) else v


def test_every_query_has_a_twin():
    assert set(load().ORACLES) == set(load().QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(load().QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rounds_land_in_several_files(spark, tmp_path):
    """Payloads of a round are read by more than one task, and three rounds fit one trigger (F20 d18c_stream_two_triggers)."""
    from checks.q_sources import _land, _round
    from checks.registry import Inputs

    i = Inputs(spark, "/root/testdata/sf0.01")
    for n in (1, 2, 3):
        _land(i, n, f"{tmp_path}/in")
    assert 3 * 8 < len(list((tmp_path / "in").glob("*.parquet"))) <= 100
    assert spark.read.parquet(f"{tmp_path}/in").count() == sum(_round(i, n).count() for n in (1, 2, 3))
