"""The streaming form of the engine: the batch operators on unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fingerspark.functions.fixed import LATENESS_SECONDS, SEVERITY_TIERS, WINDOW_SECONDS
from fingerspark.operators.alerts import raise_alerts, webhook_payloads
from fingerspark.operators.baseline import baseline_of_moments, fold_moments, image_moments
from fingerspark.operators.features import window_features
from fingerspark.operators.forest import Model
from fingerspark.operators.ingest import dead_letters, enrich, identity_of, valid_events, with_defaults
from fingerspark.operators.profiles import fold_deltas, profile_delta, profiles_of
from fingerspark.operators.registry import latest_model
from fingerspark.operators.results import observe_scoring, scorable, score_vectors, unscorable
from fingerspark.plans.retrain import REGISTRY, current_model, latest_baseline, read_versions
from fingerspark.sources import states
from fingerspark.sources.schemas import ANOMALY_RESULT, RUNTIME_EVENT, columns
from fingerspark.sources.tables import BATCH, read_batches, write_batch
from fingerspark.sources.wire import decode_json
from fingerspark.streaming.windows import HORIZON_SECONDS

IMAGE_MOMENTS = columns(
    "image_name string, n bigint, mean array<double>, m2 array<double>")
SCORING_METRICS = columns("registry_size bigint, model_version string, training_samples bigint, drift_score double, "
                          "vectors_scored bigint, anomalies bigint, "
                          + ", ".join(f"anomalies_{name.lower()} bigint" for name, _ in SEVERITY_TIERS))
PROFILE_DELTA = columns("""
    container_id string, total_events bigint, total_anomalies bigint, score_sum double, max_anomaly_score double,
    first_seen timestamp, last_seen timestamp
""")


def decoded_events(messages: DataFrame) -> DataFrame:
    """Key/value messages to runtime events, with ``raw`` and ``decode_error``."""
    return decode_json(messages, RUNTIME_EVENT)


def dead_letter_stream(events: DataFrame) -> DataFrame:
    return dead_letters(events, F.current_timestamp())


def new_event_stream(events: DataFrame, horizon_seconds: int = HORIZON_SECONDS, dedup: bool = True) -> DataFrame:
    """Valid runtime events of a stream, the first of each event_id, with a watermark on ``timestamp``.

    Ids are remembered for the horizon, on the executors' disks; what is older than that is dropped. Events
    without an id are events of their own, however alike: they are given one made of their message
    coordinates or content and take no part in the de-duplication.
    """
    usable = valid_events(events).withColumn("_copy", F.coalesce("event_id", F.expr("uuid()")))
    known = with_defaults(usable, F.current_timestamp(), identity_of(events))
    timed = known.withWatermark("timestamp", f"{horizon_seconds} seconds")
    fresh = timed.dropDuplicatesWithinWatermark(["_copy"]) if dedup else timed
    return fresh.select(*RUNTIME_EVENT.names)


def processed_stream(events: DataFrame, seconds: int = WINDOW_SECONDS,
                     lateness_seconds: int = LATENESS_SECONDS, dedup: bool = True) -> DataFrame:
    """Validated, enriched events placed in their ``window``, one per event_id.

    The watermark lies the allowed lateness behind, which suits :func:`feature_stream`: what comes
    later is dropped, and ids are forgotten as soon.
    """
    placed = enrich(new_event_stream(events, lateness_seconds, dedup), F.current_timestamp()).withColumn(
        "window", F.window("timestamp", f"{seconds} seconds"))
    # From here on the window carries the watermark; a stream may have one such column.
    plain = F.col("timestamp").alias("timestamp", metadata={"comment": "event time"})
    return placed.select(plain, *[c for c in placed.columns if c != "timestamp"])


def feature_stream(processed: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Feature vectors of closed windows (append mode), without late events and without a cap.

    Two aggregations on the JVM. :func:`~fingerspark.streaming.windows.window_stream` has both.
    """
    return window_features(processed, seconds)


def event_sink(root: str, received_at: Column | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that appends new events to ``runtime_events`` and ``processed_events``.

    Takes :func:`new_event_stream`, whose state knows the ids that are stored already, so nothing of
    the tables is read. Each batch is a folder with its dates below it; a batch that is run again
    after a failure takes the place of what it left.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        stamp = received_at if received_at is not None else F.current_timestamp()
        write_batch(batch.withColumn("date", F.to_date("timestamp")), f"{root}/runtime_events", batch_id, "date")
        stored = batch.sparkSession.read.schema(RUNTIME_EVENT).parquet(f"{root}/runtime_events/{BATCH}={batch_id}")
        processed = enrich(stored, stamp)
        write_batch(processed.withColumn("date", F.to_date("timestamp")), f"{root}/processed_events", batch_id, "date")

    return sink


def detection_sink(root: str, detected_at: Column | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function from vectors to results, profiles and alerts under ``root``.

    Every batch is stored under its id and built on what the batches before it have added, so a
    batch that is replayed after a failure replaces its own output and nothing is counted twice.
    The newest stored model is picked up at the start of a batch. Image baselines include
    the vectors of the batch they explain.
    """
    known: dict[str, Model | None] = {"model": None}

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, f"{root}/feature_vectors", batch_id)
        stored = spark.read.schema(batch.schema).parquet(f"{root}/feature_vectors/{BATCH}={batch_id}")
        stamp = detected_at if detected_at is not None else F.current_timestamp()
        write_batch(unscorable(stored, stamp), f"{root}/vector_dead_letters", batch_id)
        vectors = scorable(stored)
        own = states.add(image_moments(vectors), f"{root}/image_moments", batch_id, fold_moments)
        known_images = states.added_before(spark, f"{root}/image_moments", batch_id, IMAGE_MOMENTS).join(
            own.select("image_name"), "image_name", "left_semi")
        images = baseline_of_moments(fold_moments(known_images.unionByName(own)))
        known["model"] = current_model(spark, root, known["model"])
        overall = latest_baseline(spark, root) if known["model"] else None
        results = score_vectors(vectors, known["model"], stamp, images, overall)
        seen = Observation(f"scoring-{batch_id}")
        write_batch(observe_scoring(results, seen), f"{root}/anomaly_results", batch_id)
        write_batch(batch_metrics(spark, root, batch_id, seen.get), f"{root}/scoring_metrics", batch_id)
        maintain(spark.read.schema(ANOMALY_RESULT)
                 .parquet(f"{root}/anomaly_results/{BATCH}={batch_id}"), root, batch_id)

    return sink


def batch_metrics(spark: SparkSession, root: str, batch_id: int, counted: dict[str, int]) -> DataFrame:
    """One row: what a batch scored and found, and the state of the model it was scored with.

    The counters were taken while the results were written. Gauges of a model are null before the first.
    """
    current = latest_model(read_versions(spark, root, REGISTRY)).select(
        F.col("version").alias("model_version"), F.col("samples").alias("training_samples"), "drift_score")
    size = read_versions(spark, root, REGISTRY).agg(F.count("*").alias("registry_size"))
    row = size.join(current, F.lit(True), "left")
    return row.withColumns({name: F.lit(value) for name, value in counted.items()})


def metrics_so_far(spark: SparkSession, root: str) -> DataFrame:
    """One row: counters summed over all batches, gauges as the last batch found them.

    ``training_buffer`` counts the vectors stored so far, which the next model may train on.
    """
    rows = read_batches(spark, f"{root}/scoring_metrics", SCORING_METRICS)
    counters = [c for c in SCORING_METRICS.names if c.startswith(("vectors", "anomalies"))]
    gauges = [c for c in SCORING_METRICS.names if c not in counters]
    return rows.agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in counters],
                    *[F.max_by(c, BATCH).alias(c) for c in gauges]).withColumn("training_buffer", F.col("vectors_scored"))


def maintain(results: DataFrame, root: str, batch_id: int) -> None:
    """Add a batch of results to the profiles and raise its alerts."""
    states.add(profile_delta(results), f"{root}/container_profiles", batch_id, fold_deltas)
    alerts = raise_alerts(results)
    write_batch(alerts, f"{root}/alert_history", batch_id)
    write_batch(webhook_payloads(alerts), f"{root}/webhook_outbox", batch_id)


def stored_profiles(spark: SparkSession, root: str, before: int = 2**31 - 1) -> DataFrame:
    """The profiles that the batches before ``before`` add up to."""
    return profiles_of(fold_deltas(states.added_before(spark, f"{root}/container_profiles", before, PROFILE_DELTA)))


def start_table_sink(df: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                     every: str = "5 seconds") -> StreamingQuery:
    """Start appending a stream to a Parquet table."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(path)


def start_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  available_now: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Start feeding the micro-batches of a stream to ``sink``."""
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
