"""Where the query modules put their queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from checks.views import run_sql, with_views
from jobdelta.session import prepare

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The views and tables of one data folder, by attribute."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def __getattr__(self, name: str):
        if name.startswith("fx_"):
            return self.sql(f"SELECT * FROM {name}")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, body: str):
        return run_sql(self.spark, self.sf_dir, body)


def spread(df):
    """The rows over all cores: the tables are single small files, where a real table has many."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
