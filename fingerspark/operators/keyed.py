"""First row per key and insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank_in_key"


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in ``order``.

    The rank filter makes Spark keep one row per key and map task before the shuffle
    (WindowGroupLimit), so any number of copies of one key costs the reducer no more
    rows than there are map tasks.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str,
                     order: Sequence[str | Column]) -> DataFrame:
    """Rows of ``incoming`` to append to ``target``: first per key, key not there yet.

    The target is narrowed to the incoming keys first. With a small batch Spark
    broadcasts those keys (it checks the size) and the large target is never shuffled;
    with a large one both joins and the de-duplication share one partitioning by key.
    """
    fresh = first_per_key(incoming, [key], order)
    present = target.select(key).join(incoming.select(key).distinct(), key, "left_semi").distinct()
    return fresh.join(present, key, "left_anti")
