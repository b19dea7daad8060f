"""Running totals over ordered groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerspark.sources.tables import durable

_SLICE = "_slice"


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   totals: Mapping[str, Column]) -> DataFrame:
    """Add, per row, the sums of ``totals`` over its group up to and including the row.

    A window function would hold a whole group in one task. Here the rows are range
    partitioned by (keys, order), so a big group is cut into many slices; running sums
    are taken inside the slices and each slice is lifted by what lies ahead of it. Only
    one row per slice and group crosses between slices. The sliced rows are written out
    once, because a slice must hold the same rows in both uses.

    Keys must not be null. ``order`` has to identify a row inside its group for the
    result to be deterministic.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    own = {f"_own_{name}": value for name, value in totals.items()}
    ranged = df.withColumns(own).repartitionByRange(*keys, *order)
    sliced = durable(ranged.withColumn(_SLICE, F.spark_partition_id()))

    inside = (Window.partitionBy(_SLICE, *keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = sliced.withColumns({n: F.sum(f"_own_{n}").over(inside) for n in totals}).drop(*own)

    ahead = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_SLICE)
             .rowsBetween(Window.unboundedPreceding, -1))
    per_slice = sliced.groupBy(_SLICE, *keys).agg(
        *[F.sum(f"_own_{n}").alias(f"_sum_{n}") for n in totals])
    offsets = per_slice.select(_SLICE, *keys, *[
        F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in totals])

    joined = local.join(offsets, [_SLICE, *keys])
    lifted = {n: F.col(n) + F.col(f"_ahead_{n}") for n in totals}
    return joined.withColumns(lifted).select(*df.columns, *totals)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            name: str = "ordinal") -> DataFrame:
    """Number the rows of every group from 1 in ``order``, however large the group."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
