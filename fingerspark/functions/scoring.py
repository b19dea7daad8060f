"""Columns of the scoring, alerting and profile stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    ALERT_DESCRIPTION,
    ALERT_TITLE,
    ANOMALOUS_DESCRIPTION,
    ANOMALY_THRESHOLD,
    CONTRIBUTORS,
    FEATURE_COUNT,
    LOWEST_RISK,
    NO_SEVERITY,
    NORMAL_DESCRIPTION,
    RISK_LEVELS,
    SEVERITY_RANK,
    SEVERITY_TIERS,
    UNKNOWN_SEVERITY,
    WINDOW_EVENTS,
)


def finite_or_zero(x: Column) -> Column:
    infinite = F.abs(x) == F.lit(float("inf"))
    return F.when(F.isnan(x) | infinite, F.lit(0.0)).otherwise(x)


def clean_vector(features: Column) -> Column:
    """NaN and infinities in a vector become 0."""
    return F.transform(features, finite_or_zero)


def has_vector_length(features: Column, length: int = FEATURE_COUNT) -> Column:
    return F.coalesce(F.size(features) == length, F.lit(False))


def unit_score(raw: Column) -> Column:
    """Raw decision value shifted by one half and clipped to [0, 1]; null for null."""
    return F.when(raw.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw + F.lit(0.5))))


def is_anomalous(score: Column) -> Column:
    return score > F.lit(ANOMALY_THRESHOLD)


def severity(score: Column) -> Column:
    column = F.lit(NO_SEVERITY)
    for name, floor in reversed(SEVERITY_TIERS):
        column = F.when(score >= F.lit(floor), name).otherwise(column)
    return column


def severity_rank(name: Column) -> Column:
    column = F.lit(None).cast("int")
    for level, rank in SEVERITY_RANK.items():
        column = F.when(name == level, rank).otherwise(column)
    return column


def severity_of_rank(rank: Column) -> Column:
    column = F.lit(None).cast("string")
    for level, value in SEVERITY_RANK.items():
        column = F.when(rank == value, level).otherwise(column)
    return column


def risk_level(anomaly_rate: Column, max_score: Column) -> Column:
    column = F.lit(LOWEST_RISK)
    for level, score_floor, rate_floor in reversed(RISK_LEVELS):
        reached = (max_score >= F.lit(score_floor)) | (anomaly_rate >= F.lit(rate_floor))
        column = F.when(reached, level).otherwise(column)
    return column


def anomaly_description(score: Column, anomalous: Column, features: Column,
                        total_events: Column) -> Column:
    """Sentence shown for a result; the first three contributors are named."""
    contributors = F.when(
        F.size(features) > 0,
        F.concat(F.lit(CONTRIBUTORS), F.array_join(F.slice(features, 1, 3), ", ")),
    )
    text = F.concat_ws(
        ". ",
        F.format_string(ANOMALOUS_DESCRIPTION, score.cast("double")),
        contributors,
        F.format_string(WINDOW_EVENTS, F.coalesce(total_events, F.lit(0)).cast("long")),
    )
    return F.when(anomalous, text).otherwise(NORMAL_DESCRIPTION)


def alert_title(level: Column, container_id: Column) -> Column:
    return F.format_string(
        ALERT_TITLE, F.coalesce(level, F.lit(UNKNOWN_SEVERITY)), container_id
    )


def alert_description(score: Column, level: Column, result_id: Column) -> Column:
    return F.format_string(
        ALERT_DESCRIPTION,
        F.coalesce(score.cast("double"), F.lit(0.0)), F.coalesce(level, F.lit(UNKNOWN_SEVERITY)), result_id,
    )


def csv_of(values: Column) -> Column:
    """Array to comma-separated text; an empty array is null."""
    return F.nullif(F.concat_ws(",", values), F.lit(""))


def array_of_csv(text: Column) -> Column:
    return F.split(text, ",")


def stable_id(*parts: str) -> Column:
    """Deterministic id from columns or SQL expressions, the same on every replay."""
    texts = ", ".join(f"coalesce(CAST({part} AS STRING), '')" for part in parts)
    return F.expr(f"md5(concat_ws('|', {texts}))")


def entropy_bits(histogram_total: str, n_log_n: str, population: str) -> str:
    """SQL of the Shannon entropy in bits of a histogram with shares n/population.

    -sum(n/N log2(n/N)) = (log2(N) * sum(n) - sum(n log2 n)) / N, so only two sums
    per group travel through the shuffle instead of the histogram.
    """
    bits = f"({histogram_total} * log2({population}) - {n_log_n}) / {population}"
    return f"greatest(0D, {bits})"
