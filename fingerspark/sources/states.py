"""State that streams carry forward, as what each batch adds and, now and then, the sum of it.

A batch writes only what it adds, however large the state. A reader folds the newest base and what
was added after it. When enough has been added, the next batch writes it all as a new base. A
folder counts once its write is complete, so there is nothing to swap, and a reader that began on
the base before finds its files until there is one base more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fingerspark.sources.tables import BATCH, remove

BASE, ADDED = "base", "added"
#: Batches whose additions lie beside a base before they go into the next.
MOST_ADDED = 16


def complete_batches(spark: SparkSession, path: str) -> list[int]:
    """The batches under a folder whose writing has ended, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [entry.getPath() for entry in files.listStatus(folder)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.getName().partition("=")[2]) for n in names
                  if n.getName().startswith(f"{BATCH}=") and files.exists(done(n, "_SUCCESS")))


def added_before(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The rows whose fold is the state that batch ``batch_id`` builds upon."""
    bases = [b for b in complete_batches(spark, f"{path}/{BASE}") if b < batch_id]
    since = bases[-1] if bases else -1
    added = [b for b in complete_batches(spark, f"{path}/{ADDED}") if since < b < batch_id]
    folders = [f"{path}/{BASE}/{BATCH}={since}"] * bool(bases) + [f"{path}/{ADDED}/{BATCH}={b}" for b in added]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def add(rows: DataFrame, path: str, batch_id: int, fold: Callable[[DataFrame], DataFrame],
        most: int = MOST_ADDED) -> DataFrame:
    """Write what a batch adds and hand it back as stored; a batch that is run again replaces its own.

    ``fold`` sums rows of a state and what was added to it, and gives rows of the same columns. When
    ``most`` batches lie beside the base they are folded into a new one, before this batch.
    """
    spark = rows.sparkSession
    target = f"{path}/{ADDED}/{BATCH}={batch_id}"
    rows.write.mode("overwrite").parquet(target)
    bases = [b for b in complete_batches(spark, f"{path}/{BASE}") if b < batch_id]
    since = bases[-1] if bases else -1
    added = [b for b in complete_batches(spark, f"{path}/{ADDED}") if b < batch_id]
    beside = [b for b in added if b > since]
    if len(beside) >= most:
        older = added_before(spark, path, batch_id, rows.schema)
        fold(older).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/{BASE}/{BATCH}={beside[-1]}")
        for kind, batches in ((BASE, bases[:-1]), (ADDED, [b for b in added if b <= since])):
            for old in batches:
                remove(spark, f"{path}/{kind}/{BATCH}={old}")
    return spark.read.schema(rows.schema).parquet(target)
