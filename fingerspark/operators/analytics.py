"""Questions asked of the anomaly results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerspark.functions.scoring import severity_of_rank, severity_rank
from fingerspark.functions.timing import before, instant, minute_bucket
from fingerspark.operators.paging import equal_if_given, page_envelope, page_rows

Time = str | datetime | Column


def _between(results: DataFrame, as_of: Time, start: Time | None, end: Time | None) -> DataFrame:
    """Results detected in [start, end]; by default the 24 hours up to ``as_of``."""
    low = instant(start) if start is not None else before(as_of, hours=24)
    high = instant(end if end is not None else as_of)
    return results.filter(F.col("detected_at").between(low, high))


def find_anomalies(results: DataFrame, as_of: Time, severity: str | None = None,
                   container_id: str | None = None, start: Time | None = None,
                   end: Time | None = None) -> DataFrame:
    """Results of a time range, optionally of one severity or container (unpaged)."""
    found = _between(results, as_of, start, end)
    found = equal_if_given(found, "severity", severity, upper=True)
    return equal_if_given(found, "container_id", container_id)


def anomaly_page(results: DataFrame, as_of: Time, page: int = 0, size: int = 20, **filters) -> DataFrame:
    """A page of results, newest first."""
    found = find_anomalies(results, as_of, **filters)
    return page_rows(found, "detected_at", "result_id", page, size)


def anomaly_envelope(results: DataFrame, as_of: Time, page: int = 0, size: int = 20, **filters) -> DataFrame:
    return page_envelope(find_anomalies(results, as_of, **filters), page, size)


def stats(results: DataFrame, since: Time, generated_at: Time) -> DataFrame:
    """One row of counts over everything scored after ``since``, from one scan.

    Severity counts include results that are not anomalous; containers are counted
    where they had an anomaly.
    """
    anomalous = F.coalesce("is_anomalous", F.lit(False))
    return results.filter(F.col("detected_at") > instant(since)).agg(
        F.count_if(anomalous).alias("total_anomalies"),
        F.count("*").alias("total_scored"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("avg_anomaly_score"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "HIGH").alias("high_count"),
        F.count_distinct(F.when(anomalous, F.col("container_id"))).alias("affected_containers"),
    ).withColumns({"since": instant(since), "generated_at": instant(generated_at)})


def anomaly_trend(results: DataFrame, as_of: Time, bucket_minutes: int = 15,
                  start: Time | None = None, end: Time | None = None) -> DataFrame:
    """Scored, anomalous and average score per minute bucket, oldest first."""
    bucket = minute_bucket(F.col("detected_at"), bucket_minutes).alias("bucket")
    return _between(results, as_of, start, end).groupBy(bucket).agg(
        F.count("*").alias("total"),
        F.count_if("is_anomalous").alias("anomalies"),
        F.avg("anomaly_score").alias("avg_score"),
    ).orderBy("bucket")


def severity_over_time(results: DataFrame, as_of: Time, bucket_minutes: int = 15,
                       start: Time | None = None, end: Time | None = None) -> DataFrame:
    """Anomalies per minute bucket and severity."""
    bucket = minute_bucket(F.col("detected_at"), bucket_minutes).alias("bucket")
    return (_between(results, as_of, start, end).filter("is_anomalous")
            .groupBy(bucket, "severity").agg(F.count("*").alias("count"))
            .orderBy("bucket", "severity"))


def top_risky_containers(results: DataFrame, as_of: Time, hours: int = 24, limit: int = 10) -> DataFrame:
    """Containers with most anomalies, then the highest score.

    ``worst_severity`` is by rank; ``max_severity_lex`` is the alphabetical maximum that
    a plain MAX over the text gives.
    """
    recent = results.filter("is_anomalous").filter(F.col("detected_at") > before(as_of, hours=hours))
    # Text maxima cannot be hash aggregated; counted per severity first, they only see the
    # few severities of a container.
    per_severity = recent.groupBy("container_id", "severity").agg(
        F.count("*").alias("n"), F.max("anomaly_score").alias("top"), F.sum("anomaly_score").alias("total"))
    return per_severity.groupBy("container_id").agg(
        F.sum("n").alias("anomaly_count"),
        F.max("top").alias("max_score"),
        (F.sum("total") / F.sum("n")).alias("avg_score"),
        severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("worst_severity"),
        F.max("severity").alias("max_severity_lex"),
    ).orderBy(F.desc("anomaly_count"), F.desc("max_score"), "container_id").limit(limit)


def count_events(events: DataFrame, container_id: str | None = None) -> DataFrame:
    return equal_if_given(events, "container_id", container_id).agg(F.count("*").alias("n"))


def count_events_by_container(events: DataFrame) -> DataFrame:
    return events.groupBy("container_id").agg(F.count("*").alias("n"))
