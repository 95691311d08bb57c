"""Time arguments. No operator reads the clock: `now` and `today` always come from the caller."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(now: dt.datetime | str) -> Column:
    """A UTC instant as a literal."""
    return F.lit(str(now).replace("T", " ")).cast("timestamp_ntz")


def ago(now: dt.datetime | str, **span: int) -> Column:
    when = now if isinstance(now, dt.datetime) else dt.datetime.fromisoformat(now)
    return at(when - dt.timedelta(**span))


def day(today: dt.date | str, minus: int = 0) -> Column:
    d = today if isinstance(today, dt.date) else dt.date.fromisoformat(today)
    return F.lit((d - dt.timedelta(days=minus)).isoformat()).cast("date")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
