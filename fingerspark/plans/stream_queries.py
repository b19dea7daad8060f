"""Registered queries that run as streams over the given tables and return what they wrote."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fingerspark.operators import ingest
from fingerspark.plans import ingest_queries, telemetry  # noqa: F401 (its checks are used below)
from fingerspark.plans.check_sql import ALERTS, NOW, PROFILES, RESULTS, ROUNDED_FEATURES, RUNTIME, VECTORS, feature_ctes
from fingerspark.plans.detection_queries import ALERT as SHOWN_ALERT
from fingerspark.plans.detection_queries import SQL_PROFILE, shown_profiles
from fingerspark.plans.feature_queries import IDENTITY, flat
from fingerspark.plans.registered import CHECKS, query
from fingerspark.plans.retrain import retrain
from fingerspark.plans.telemetry import WINDOW, feature_vectors
from fingerspark.sources.schemas import (
    ALERT,
    ANOMALY_RESULT,
    FEATURE_VECTOR,
    PROCESSED_EVENT,
    RUNTIME_EVENT,
    conform,
)
from fingerspark.sources.tables import durable, read_batches, shared_folder
from fingerspark.sources.topics import read_file_stream
from fingerspark.streaming import jobs, windows

def _runtime(activity: DataFrame, *keep: str) -> DataFrame:
    """Runtime events with zoned times, as streams need them, next to columns of the source."""
    projected = telemetry.project_runtime(activity)
    timed = projected.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    known = [c for c in RUNTIME_EVENT.names if c in timed.columns]
    return timed.select(*known, *keep)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _wall_clock(df: DataFrame) -> DataFrame:
    """Zoned timestamps back to the wall-clock ones of the given tables."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


SLICES = 4
# Events are remembered longer than the given ones span.
HORIZON = 400 * 24 * 3600


def _arriving(events: DataFrame, number: str) -> list[DataFrame]:
    """Events in the slices in which they arrive; ``number`` is the SQL of the slice."""
    stored = durable(events.withColumn("slice", F.expr(number)))
    return [stored.filter(F.col("slice") == i).drop("slice") for i in range(stored.agg(F.max("slice")).first()[0] + 1)]


def _in_time_order(spark: SparkSession, sf_dir: str, copies: bool = False) -> list[DataFrame]:
    """The events in slices by time; copies of some, changed, come one slice after the first."""
    events = _runtime(telemetry.read(spark, sf_dir, "events"), "k", "seq")
    first, last = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    length = (last - first).total_seconds() / SLICES + 1
    placed = events.withColumn("n", F.floor(
        (F.unix_micros("timestamp") / 1e6 - F.lit(first.timestamp())) / F.lit(length)).cast("int"))
    if copies:
        again = placed.filter("k = 5").withColumns({
            "timestamp": F.expr("timestamp + INTERVAL 1 SECOND"), "process_name": F.lit("copy"), "n": F.expr("n + 1")})
        placed = placed.unionByName(again)
    return [part.drop("n", "k", "seq") for part in _arriving(placed, "n")]


def _closing(events: DataFrame) -> DataFrame:
    """One event a day after all others, in a container of its own: all their windows close."""
    last = events.agg(F.max("timestamp").alias("timestamp")).select(
        F.lit("closing").alias("event_id"), F.expr("timestamp + INTERVAL 1 DAY").alias("timestamp"),
        F.lit("closing").alias("container_id"), F.lit("read").alias("syscall"))
    return conform(last, RUNTIME_EVENT)


def _run(spark: SparkSession, root: str, arriving: list[DataFrame],
         start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let the slices arrive one after the other; each is taken up by a run from the checkpoint before."""
    for part in arriving:
        conform(part, RUNTIME_EVENT).write.mode("append").parquet(f"{root}/incoming")
        start(read_file_stream(spark, f"{root}/incoming", RUNTIME_EVENT)).awaitTermination()


def _vectors(spark: SparkSession, arriving: list[DataFrame], max_events: int | None = None) -> DataFrame:
    """What the window stream has written when all slices have arrived; without a count cap unless one is given."""
    root = _folder(spark, "stream-features")

    def start(events: DataFrame) -> StreamingQuery:
        processed = ingest.enrich(jobs.new_event_stream(events, HORIZON), telemetry.AS_OF)
        vectors = windows.window_stream(processed, WINDOW, horizon_seconds=HORIZON, max_events=max_events)
        return jobs.start_table_sink(vectors, f"{root}/vectors", f"{root}/checkpoint", available_now=True)

    _run(spark, root, arriving, start)
    schema = T.StructType([*FEATURE_VECTOR.fields, T.StructField("generation", T.IntegerType())])
    return _wall_clock(spark.read.schema(schema).parquet(f"{root}/vectors"))


@query(f"WITH {VECTORS} SELECT {IDENTITY}, {ROUNDED_FEATURES} FROM vectors")
def stream_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of events that arrive as a stream, some of them twice: those of the whole table."""
    arriving = _in_time_order(spark, sf_dir, copies=True)
    return flat(_vectors(spark, [*arriving, _closing(arriving[-1])]))


def _numbered_vectors(chunk: str) -> str:
    """SQL of vectors by generation; the first of a window has the id that it has without one."""
    plain = f"md5(concat_ws('|', container_id, strftime(ws, '%Y%m%d%H%M%S'), '{WINDOW}'))"
    return f"""WITH {RUNTIME},
placed AS (SELECT *, {chunk} AS chunk
           FROM (SELECT *, time_bucket(INTERVAL {WINDOW} SECOND, "timestamp") AS ws,
                        time_bucket(INTERVAL {WINDOW} SECOND, "timestamp") + INTERVAL {WINDOW} SECOND AS we FROM processed)),
{feature_ctes(extra=', chunk')}
SELECT CASE WHEN chunk = 0 THEN {plain} ELSE vector_id END AS vector_id, {IDENTITY.split(", ", 1)[1]},
       CAST(chunk AS INT) AS generation, {ROUNDED_FEATURES} FROM vectors"""


@query(_numbered_vectors('(row_number() OVER (PARTITION BY container_id, ws ORDER BY "timestamp", event_id) - 1) // 10'))
def stream_window_features_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that give a vector whenever they reach ten events, on a stream."""
    arriving = _in_time_order(spark, sf_dir)
    return flat(_vectors(spark, [*arriving, _closing(arriving[-1])], max_events=10), "generation")


@query(_numbered_vectors("CASE WHEN k % 10 = 7 AND bool_or(k % 10 <> 7) OVER (PARTITION BY container_id, ws) THEN 1 ELSE 0 END"))
def stream_late_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events comes after all windows have closed: their vectors are supplementary ones."""
    events = _runtime(telemetry.read(spark, sf_dir, "events"), "k")
    punctual, late = _arriving(events, "CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END")
    return flat(_vectors(spark, [punctual, _closing(events), late]), "generation")


@query(CHECKS["dedup_processed"])
def stream_processed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event tables that a stream with copies fills, one of whose batches fails and is run again."""
    root = _folder(spark, "stream-events")
    sink = jobs.event_sink(root, F.lit(telemetry.AS_OF).cast("timestamp"))
    failed = []

    def failing(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("the batch is written but not committed")

    def start(events: DataFrame) -> StreamingQuery:
        running = jobs.start_batches(jobs.new_event_stream(events, HORIZON), failing, f"{root}/checkpoint", available_now=True)
        try:
            running.awaitTermination()
        except StreamingQueryException:
            if not failed:
                raise
            return start(events)
        return running

    _run(spark, root, _in_time_order(spark, sf_dir, copies=True), start)
    stored = read_batches(spark, f"{root}/processed_events", PROCESSED_EVENT)
    return _wall_clock(stored.select("event_id", "timestamp", "container_id", "syscall", "process_name"))


def _scored(spark: SparkSession, sf_dir: str) -> str:
    """Train on the vectors, then let them arrive as a stream in two batches to be scored."""
    root = _folder(spark, "stream-scores")
    vectors = feature_vectors(spark, sf_dir)
    zoned = durable(vectors.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")}))
    retrain(zoned, root, telemetry.AS_OF_TIME)
    sink = jobs.detection_sink(root, F.col("window_end"))
    for half in (0, 1):
        zoned.filter(F.crc32("vector_id") % 2 == half).write.mode("append").parquet(f"{root}/incoming")
        incoming = read_file_stream(spark, f"{root}/incoming", zoned.schema)
        jobs.start_batches(incoming, sink, f"{root}/checkpoint", available_now=True).awaitTermination()
    return root


@query()
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors arriving as a stream, scored under a model trained before it starts."""
    results = read_batches(spark, f"{_scored(spark, sf_dir)}/anomaly_results", ANOMALY_RESULT)
    return _wall_clock(results.select(
        "result_id", "vector_id", "container_id", "detected_at", "anomaly_score", "is_anomalous", "severity",
        "model_version", "description"))


@query(f"""WITH {VECTORS}
SELECT CAST(2 AS BIGINT) AS batches, count(*) AS vectors_scored, count(*) AS training_samples, count(*) AS training_buffer,
       CAST(1 AS BIGINT) AS registry_size, strftime({NOW}, '%Y%m%d%H%M%S') AS model_version, CAST(0 AS DOUBLE) AS drift_score,
       TRUE AS tiers_add_up, TRUE AS as_stored FROM vectors""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and gauges of a scoring stream. Anomalies are held against the stored results."""
    root = _scored(spark, sf_dir)
    stored = read_batches(spark, f"{root}/anomaly_results", ANOMALY_RESULT).agg(F.count_if("is_anomalous").alias("found"))
    tiers = sum((F.col(c) for c in jobs.SCORING_METRICS.names if c.startswith("anomalies_")), F.lit(0))
    return jobs.metrics_so_far(spark, root).join(stored, F.lit(True)).select(
        "batches", "vectors_scored", "training_samples", "training_buffer", "registry_size", "model_version", "drift_score",
        (tiers == F.col("anomalies")).alias("tiers_add_up"), (F.col("anomalies") == F.col("found")).alias("as_stored"))


def _maintained(spark: SparkSession, sf_dir: str) -> str:
    """Feed the results, as a stream of files, to the profile and alert tables."""
    root = _folder(spark, "stream-profiles")
    results = telemetry.anomaly_results(spark, sf_dir)
    stamps = ("detected_at", "window_start", "window_end")
    conform(results.withColumns({c: F.col(c).cast("timestamp") for c in stamps}), ANOMALY_RESULT).repartition(
        4, "detected_at").write.parquet(f"{root}/incoming")
    incoming = read_file_stream(spark, f"{root}/incoming", ANOMALY_RESULT, max_files=1)

    def sink(batch: DataFrame, batch_id: int) -> None:
        jobs.maintain(batch, root, batch_id)

    jobs.start_batches(incoming, sink, f"{root}/checkpoint", available_now=True).awaitTermination()
    return root


@query(f"WITH {RESULTS}, {PROFILES} SELECT {SQL_PROFILE} FROM profiles")
def stream_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles carried forward batch by batch."""
    root = _maintained(spark, sf_dir)
    return shown_profiles(_wall_clock(jobs.stored_profiles(spark, root)))


@query(f"WITH {RESULTS}, {ALERTS} SELECT {SHOWN_ALERT} FROM alerts")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts raised batch by batch."""
    root = _maintained(spark, sf_dir)
    return _wall_clock(read_batches(spark, f"{root}/alert_history", ALERT).select(*SHOWN_ALERT.split(", ")))
