"""Pages of ordered rows and their envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked_size(size: int) -> int:
    """A page size as given; one below 1 is refused."""
    if size < 1:
        raise ValueError("a page has at least one row")
    return size


def page_rows(df: DataFrame, newest: str, key: str, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of ``df``, newest ``newest`` first, then by the unique ``key``.

    Rows without a time come last. Rows are counted per hour first, which tells the hours
    that the page lies in. Only these are read again, as a time range that the scan can
    prune by, so the top-k that follows is as deep as an hour, however far down the page.
    """
    first, last = page * checked_size(size), (page + 1) * size
    newest_first = Window.orderBy(F.desc_nulls_last("hour"))
    hours = df.groupBy(F.date_trunc("HOUR", newest).alias("hour")).count().withColumn(
        "seen", F.sum("count").over(newest_first))
    ahead = F.col("seen") - F.col("count")
    flavour = df.schema[newest].dataType
    bounds = hours.filter((F.col("seen") > first) & (ahead < last)).agg(
        F.min("hour").cast(flavour).cast("string").alias("low"),
        (F.max("hour") + F.make_dt_interval(hours=F.lit(1))).cast(flavour).cast("string").alias("high"),
        F.max(F.col("hour").isNull()).alias("timeless"), F.min(ahead).alias("skipped")).first()
    if bounds["skipped"] is None:
        return df.limit(0)
    within = F.lit(False)
    if bounds["low"] is not None:
        low, high = (F.lit(bounds[b]).cast(flavour) for b in ("low", "high"))
        within = (F.col(newest) >= low) & (F.col(newest) < high)
    if bounds["timeless"]:
        within = F.coalesce(within, F.lit(False)) | F.col(newest).isNull()
    return df.filter(within).orderBy(F.desc_nulls_last(newest), F.col(key)).offset(
        first - bounds["skipped"]).limit(size)


def page_envelope(df: DataFrame, page: int, size: int) -> DataFrame:
    """One row: page, size, total_elements, total_pages, has_next."""
    size = checked_size(size)
    total = F.col("total_elements")
    pages = F.ceil(total / F.lit(size)).cast("int")
    return df.agg(F.count("*").alias("total_elements")).select(
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        total,
        pages.alias("total_pages"),
        (F.lit(page) < pages - 1).alias("has_next"),
    )


def equal_if_given(df: DataFrame, column: str, value: str | bool | None, upper: bool = False) -> DataFrame:
    """Equality filter that a missing or blank value switches off."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return df
    wanted = value.upper() if upper and isinstance(value, str) else value
    return df.filter(F.col(column) == F.lit(wanted))


def by_id(df: DataFrame, column: str, value: str) -> DataFrame:
    """The row with this key; no row when there is none."""
    return df.filter(F.col(column) == F.lit(value)).limit(1)
