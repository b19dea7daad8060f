"""Event-time helpers. Every "now" in the engine is an explicit ``as_of`` argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: str | datetime | Column) -> Column:
    """A literal point in time. Strings and naive datetimes are wall-clock UTC."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def before(value: str | datetime | Column, *, hours: int = 0, days: int = 0) -> Column:
    """The instant ``hours``/``days`` ahead of ``value``."""
    return instant(value) - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(0), F.lit(0))


def minute_bucket(ts: Column, minutes: int) -> Column:
    """``ts`` cut to the minute, less its minute-of-hour modulo ``minutes``.

    Unlike ``window()`` the buckets restart every hour, which is what dashboards
    built on minute-of-hour arithmetic expect.
    """
    if minutes < 1:
        raise ValueError("a bucket has at least one minute")
    back = F.minute(ts) % F.lit(minutes)
    cut = F.date_trunc("MINUTE", ts).cast("timestamp_ntz")
    return cut - F.make_dt_interval(F.lit(0), F.lit(0), back, F.lit(0))


def compact_time(ts: str) -> str:
    """SQL of ``ts`` as ``yyyyMMddHHmmss`` text, used inside deterministic ids and versions."""
    return f"date_format({ts}, 'yyyyMMddHHmmss')"
