"""Durable tables as Parquet: appends, replay-safe batches, snapshots, retention."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from fingerspark.functions.fixed import RETENTION_DAYS
from fingerspark.functions.timing import before

BATCH = "batch_id"
# Conditions of a path without a table: no folder, or a folder without files.
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
# Where the durable tables lie that are still in use.
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session
    that names none gets a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="fingerspark-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The rows are computed once, survive the loss of executors, and later plans start
    from files whose size Spark knows. Tables of one application lie in one folder named
    after it, to be removed when it is over; :func:`release` removes one that is done with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/table-{uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


def release(*tables: DataFrame) -> None:
    """Remove durable tables that no plan yet to be run reads."""
    for table in tables:
        path = _STORED.pop(table, None)
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_rows(df: DataFrame, path: str, date_of: str | None = None) -> None:
    """Append to a table, partitioned by the date of column ``date_of``.

    The rebalance hint brings a date's rows together before the write, so a date is a
    few large files; adaptive execution splits the dates that are too big for one task.
    """
    if date_of is None:
        df.write.mode("append").parquet(path)
        return
    dated = df.withColumn("date", F.to_date(date_of)).hint("rebalance", "date")
    dated.write.mode("append").partitionBy("date").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Write one micro-batch of a table. A replayed batch overwrites itself."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/{BATCH}={batch_id}")


def write_clustered(df: DataFrame, path: str, key: str) -> None:
    """Write a table for lookups by ``key``: ranges of it in files, ordered inside, with a filter of its values.

    A lookup reads the footers of the files and then only the row groups whose least and greatest value
    and whose filter allow the key.
    """
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a table, empty when none has been written."""
    try:
        return spark.read.option("mergeSchema", "false").parquet(path)
    except AnalysisException as error:
        return empty_if_missing(spark, error, schema)


def empty_if_missing(spark: SparkSession, error: AnalysisException, schema: T.StructType) -> DataFrame:
    """An empty table where the error says that nothing is stored; any other error goes on."""
    if error.getCondition() not in NOTHING_STORED:
        raise error
    return spark.createDataFrame([], schema)


def keep_recent(df: DataFrame, table: str, ts: str, as_of: str | datetime | Column) -> DataFrame:
    """Rows of ``table`` still within its retention at ``as_of``."""
    return df.filter(F.col(ts) >= before(as_of, days=RETENTION_DAYS[table]))


def drop_expired(spark: SparkSession, path: str, table: str, as_of: datetime) -> list[str]:
    """Remove the dates of a table, stored by batch and date, that have left its retention wholly.

    A date goes when its last moment is older than the retention; the rows of the date in which it
    ends go with that date. Gives the dates removed.
    """
    first = (as_of - timedelta(days=RETENTION_DAYS[table])).date().isoformat()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCH}=*/date=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    dates = {entry.getPath().toString(): entry.getPath().getName().partition("=")[2] for entry in found}
    expired = {p: d for p, d in dates.items() if d < first}
    for old in expired:
        remove(spark, old)
    return sorted(set(expired.values()))
