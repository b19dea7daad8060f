"""Container profiles: folding results into per-container state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerspark.functions.scoring import risk_level
from fingerspark.operators.ordered import running_totals
from fingerspark.operators.paging import equal_if_given, page_envelope, page_rows
from fingerspark.sources.schemas import CONTAINER_PROFILE, conform
from fingerspark.sources.tables import durable

#: Values of a kind that a profile row lists.
MOST_LISTED = 10_000


def profile_delta(results: DataFrame) -> DataFrame:
    """What a set of results adds to the profiles: counts, score sum and maximum, first/last seen."""
    score = F.coalesce("anomaly_score", F.lit(0.0))
    return results.filter(F.col("container_id").isNotNull()).groupBy("container_id").agg(
        F.count("*").alias("total_events"),
        F.count_if("is_anomalous").alias("total_anomalies"),
        F.sum(score).alias("score_sum"),
        F.max(score).alias("max_anomaly_score"),
        F.min("detected_at").alias("first_seen"),
        F.max("detected_at").alias("last_seen"),
    )


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """The sum of any number of deltas, which is a delta again."""
    return deltas.groupBy("container_id").agg(
        F.sum("total_events").alias("total_events"), F.sum("total_anomalies").alias("total_anomalies"),
        F.sum("score_sum").alias("score_sum"), F.max("max_anomaly_score").alias("max_anomaly_score"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def profiles_of(delta: DataFrame) -> DataFrame:
    """Profiles of everything that a delta, one row per container, sums up."""
    return _finish(delta.withColumn("avg_anomaly_score", F.col("score_sum") / F.col("total_events")))


def _finish(totals: DataFrame) -> DataFrame:
    rate = F.col("total_anomalies") / F.col("total_events")
    return conform(totals.withColumns({
        "anomaly_rate": rate,
        "risk_level": risk_level(rate, F.col("max_anomaly_score")),
    }), CONTAINER_PROFILE)


def container_profiles(results: DataFrame) -> DataFrame:
    """Profiles of everything in ``results``, from scratch."""
    return profiles_of(profile_delta(results))


def merge_profiles(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Upsert: profiles after ``delta``. Both sides hold one row per container.

    A known container keeps its metadata and, as long as results arrive in order, its
    first_seen; its measures move on. Those without news stay as they are.
    """
    old = state.select("container_id", *[
        F.col(c).alias(f"_{c}") for c in CONTAINER_PROFILE.names if c != "container_id"])
    joined = old.join(delta, "container_id", "full_outer")

    def count(column: str) -> Column:
        return F.coalesce(column, F.lit(0)).cast("bigint")

    events = count("_total_events") + count("total_events")
    # The old average moves by what the new scores differ from it; without news it stays
    # the very same number.
    old_average = F.coalesce("_avg_anomaly_score", F.lit(0.0))
    news = F.coalesce("score_sum", F.lit(0.0)) - old_average * count("total_events")
    return _finish(joined.select(
        "container_id",
        *[F.col(f"_{c}").alias(c) for c in ("container_name", "image_name", "namespace")],
        F.least("_first_seen", "first_seen").alias("first_seen"),
        F.greatest("_last_seen", "last_seen").alias("last_seen"),
        events.alias("total_events"),
        (count("_total_anomalies") + count("total_anomalies")).alias("total_anomalies"),
        (old_average + news / events).alias("avg_anomaly_score"),
        F.greatest("_max_anomaly_score", "max_anomaly_score").alias("max_anomaly_score"),
    ))


def score_trajectory(results: DataFrame) -> DataFrame:
    """Running count and average score of a container after each of its results."""
    known = results.filter(F.col("container_id").isNotNull()).select(
        "result_id", "container_id", "detected_at", F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"))
    summed = running_totals(
        known, ["container_id"], ["detected_at", "result_id"],
        {"seen": F.lit(1).cast("bigint"), "score_sum": F.col("anomaly_score")})
    return summed.withColumn("running_avg", F.col("score_sum") / F.col("seen")).drop("score_sum")


def baseline_behaviour(events: DataFrame) -> DataFrame:
    """Learned behaviour in long form: (container_id, kind, value, n, share).

    ``kind`` is syscall, process or destination; ``share`` is the value's part of all the
    container's events. A container with millions of destinations is millions of rows,
    never one.
    """
    values = events.select("container_id", F.explode(F.array(
        F.struct(F.lit("syscall").alias("kind"), F.col("syscall").alias("value")),
        F.struct(F.lit("process").alias("kind"), F.col("process_name").alias("value")),
        F.struct(F.lit("destination").alias("kind"), F.col("destination_ip").alias("value")),
    )).alias("v")).select("container_id", "v.kind", "v.value")
    present = values.filter("kind = 'syscall' OR value IS NOT NULL")
    counted = durable(present.groupBy("container_id", "kind", "value").agg(F.count("*").alias("n")))
    # Every event counts once among the syscalls, also those without one.
    totals = counted.filter("kind = 'syscall'").groupBy("container_id").agg(F.sum("n").alias("total"))
    return counted.filter("value IS NOT NULL").join(totals, "container_id").withColumn(
        "share", F.col("n") / F.col("total")).drop("total")


def behaviour_columns(behaviour: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """The behaviour of containers as profile columns: one map and two sorted arrays.

    Of each kind a row lists the ``most`` frequent values, equally frequent ones in order, so no
    container makes a row without bound; all of them stay in ``behaviour``.
    """
    def of(kind: str, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, value)))

    frequent = Window.partitionBy("container_id", "kind").orderBy(F.desc("n"), "value")
    listed = behaviour.withColumn("_nth", F.row_number().over(frequent)).filter(F.col("_nth") <= most)
    return listed.groupBy("container_id").agg(
        F.map_from_entries(of("syscall", F.struct("value", "share"))).alias("baseline_syscall_distribution"),
        of("process", F.col("value")).alias("baseline_process_list"),
        of("destination", F.col("value")).alias("baseline_network_destinations"),
    )


def find_containers(profiles: DataFrame, risk_level: str | None = None) -> DataFrame:
    return equal_if_given(profiles, "risk_level", risk_level, upper=True)


def container_page(profiles: DataFrame, page: int = 0, size: int = 20,
                   risk_level: str | None = None) -> DataFrame:
    """A page of profiles, last seen first."""
    found = find_containers(profiles, risk_level)
    return page_rows(found, "last_seen", "container_id", page, size)


def container_envelope(profiles: DataFrame, page: int = 0, size: int = 20,
                       risk_level: str | None = None) -> DataFrame:
    return page_envelope(find_containers(profiles, risk_level), page, size)
