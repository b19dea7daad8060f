"""Alerts: raising, listing, acknowledging, explaining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerspark.functions.fixed import ALERTING_SEVERITIES
from fingerspark.functions.scoring import alert_description, alert_title, stable_id
from fingerspark.operators.keyed import first_per_key
from fingerspark.operators.paging import equal_if_given, page_envelope, page_rows
from fingerspark.sources.schemas import ACKNOWLEDGEMENT, ALERT, conform
from fingerspark.sources.tables import read_batches, write_batch
from fingerspark.sources.wire import json_of


def raise_alerts(results: DataFrame) -> DataFrame:
    """An open alert for every anomalous result of an alerting severity."""
    grave = F.col("is_anomalous") & F.col("severity").isin(*ALERTING_SEVERITIES)
    return conform(results.filter(grave).select(
        stable_id("'alert'", "result_id").alias("alert_id"),
        "result_id",
        "container_id",
        "severity",
        alert_title(F.col("severity"), F.col("container_id")).alias("title"),
        alert_description(F.col("anomaly_score"), F.col("severity"), F.col("result_id")).alias("description"),
        "anomaly_score",
        F.lit(False).alias("acknowledged"),
        F.col("detected_at").alias("created_at"),
    ), ALERT)


def webhook_payloads(alerts: DataFrame) -> DataFrame:
    """The JSON body to deliver per alert. Delivery itself is left to an outbox reader."""
    body = json_of("alert_id", "container_id", "severity", "anomaly_score", "title",
                   F.col("created_at").alias("triggered_at"))
    return alerts.select("alert_id", body.alias("payload"))


def find_alerts(alerts: DataFrame, severity: str | None = None,
                acknowledged: bool | None = None) -> DataFrame:
    found = equal_if_given(alerts, "severity", severity, upper=True)
    return equal_if_given(found, "acknowledged", acknowledged)


def alert_page(alerts: DataFrame, page: int = 0, size: int = 20, severity: str | None = None,
               acknowledged: bool | None = None) -> DataFrame:
    """A page of alerts, newest first."""
    found = find_alerts(alerts, severity, acknowledged)
    return page_rows(found, "created_at", "alert_id", page, size)


def alert_envelope(alerts: DataFrame, page: int = 0, size: int = 20, severity: str | None = None,
                   acknowledged: bool | None = None) -> DataFrame:
    return page_envelope(find_alerts(alerts, severity, acknowledged), page, size)


def acknowledge(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts after acknowledgement requests (alert_id, acknowledged_by, acknowledged_at).

    The first request for an open alert wins; one already acknowledged keeps its mark.
    ``updated`` tells which alerts changed.
    """
    first = first_per_key(requests, ["alert_id"], ["acknowledged_at", "acknowledged_by"]).select(
        "alert_id",
        F.col("acknowledged_by").alias("_by"),
        F.col("acknowledged_at").alias("_at"),
        F.lit(True).alias("_requested"),
    )
    taken = ~F.col("acknowledged") & F.coalesce("_requested", F.lit(False))
    return alerts.join(first, "alert_id", "left").withColumns({
        "updated": taken,
        "acknowledged_by": F.when(taken, F.col("_by")).otherwise(F.col("acknowledged_by")),
        "acknowledged_at": F.when(taken, F.col("_at")).otherwise(F.col("acknowledged_at")),
        "acknowledged": F.col("acknowledged") | taken,
    }).select(*alerts.columns, "updated")


def store_acknowledgements(requests: DataFrame, root: str, batch_id: int) -> None:
    """Append a batch of requests to the table of acknowledgements; a replay overwrites itself."""
    write_batch(requests.select(*ACKNOWLEDGEMENT.names), f"{root}/acknowledgements", batch_id)


def current_alerts(alerts: DataFrame, root: str) -> DataFrame:
    """The stored alerts with all stored acknowledgements applied, the first of each alert."""
    stored = read_batches(alerts.sparkSession, f"{root}/acknowledgements", ACKNOWLEDGEMENT)
    return acknowledge(alerts, stored.select(*ACKNOWLEDGEMENT.names)).drop("updated")


def alert_lineage(alerts: DataFrame, results: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every alert with the result and the feature vector behind it."""
    scored = results.select(
        "result_id", "vector_id", "model_version", "contributing_features", "window_start", "window_end")
    measured = vectors.select("vector_id", "total_events", "features")
    return alerts.join(scored, "result_id", "left").join(measured, "vector_id", "left")
