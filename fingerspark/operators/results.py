"""Anomaly results from scored vectors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fingerspark.functions.fixed import FEATURE_COUNT, NO_MODEL_VERSION, SEVERITY_TIERS
from fingerspark.functions.scoring import (
    anomaly_description,
    clean_vector,
    array_of_csv,
    array_of_csv,
    csv_of,
    has_vector_length,
    is_anomalous,
    severity,
    stable_id,
    unit_score,
)
from fingerspark.functions.timing import instant
from fingerspark.operators.baseline import contributing_features
from fingerspark.operators.forest import Model, raw_decision
from fingerspark.sources.schemas import ANOMALY_RESULT, conform

WRONG_LENGTH = f"features must have {FEATURE_COUNT} values"


def decide(scored: DataFrame, raw: str = "raw_score") -> DataFrame:
    """Score, flag and severity of a raw decision value.

    Flag and tier look at the unrounded score: exactly 0.5 is LOW and not anomalous.
    """
    score = unit_score(F.col(raw))
    return scored.withColumns({
        "anomaly_score": F.round(score, 6),
        "is_anomalous": is_anomalous(score),
        "severity": severity(score),
    })


def assemble(decided: DataFrame, version: str, detected_at: str | datetime | Column) -> DataFrame:
    """Result rows: ids derived from vector and model, the description, the window."""
    described = anomaly_description(
        F.col("anomaly_score"), F.col("is_anomalous"), F.col("contributing_features"),
        F.col("total_events"))
    result = decided.withColumns({
        "result_id": stable_id("vector_id", f"'{version}'"),
        "model_version": F.lit(version),
        "detected_at": instant(detected_at),
        "description": described,
    })
    return conform(result, ANOMALY_RESULT)


def scorable(vectors: DataFrame) -> DataFrame:
    """Vectors of full length, with NaN and infinities as 0: for scores and moments alike."""
    usable = vectors.filter(has_vector_length(F.col("features")))
    return usable.withColumn("features", clean_vector(F.col("features")))


def unscorable(vectors: DataFrame, received_at: str | datetime | Column) -> DataFrame:
    """Dead letters of the vectors that cannot be scored: raw text, reason, time."""
    bad = vectors.filter(~has_vector_length(F.col("features")))
    return bad.select("vector_id", F.to_json(F.struct(*bad.columns)).alias("raw"),
                      F.lit(WRONG_LENGTH).alias("reason"), instant(received_at).alias("received_at"))


def score_vectors(vectors: DataFrame, model: Model | None, detected_at: str | datetime | Column,
                  images: DataFrame | None = None, overall: DataFrame | None = None,
                  image_blocks_overall: bool = False) -> DataFrame:
    """Results of feature vectors under a model; neutral results while there is none.

    Vectors of wrong length or without features get no result; ``unscorable`` has them.
    """
    usable = scorable(vectors)
    if model is None:
        return unscored(usable, detected_at)
    decided = decide(raw_decision(usable, model))
    explained = contributing_features(
        decided, images, overall, image_blocks_overall=image_blocks_overall)
    return assemble(explained, model.version, detected_at)


def unscored(vectors: DataFrame, detected_at: str | datetime | Column) -> DataFrame:
    """Results before the first model: score 0, LOW, no contributors."""
    neutral = vectors.withColumns({
        "anomaly_score": F.lit(0.0),
        "is_anomalous": F.lit(False),
        "severity": F.lit("LOW"),
        "contributing_features": F.array().cast("array<string>"),
    })
    return assemble(neutral, NO_MODEL_VERSION, detected_at)


def stored_form(results: DataFrame) -> DataFrame:
    """Results as the flat table keeps them: contributors as text, missing severity LOW."""
    return results.withColumns({
        "contributing_features": csv_of(F.col("contributing_features")),
        "severity": F.coalesce("severity", F.lit("LOW")),
        "is_anomalous": F.coalesce("is_anomalous", F.lit(False)),
    })


def of_stored_form(stored: DataFrame) -> DataFrame:
    """Results from the rows of the flat table: contributors as an array, empty where there were none."""
    listed = F.coalesce(array_of_csv(F.col("contributing_features")), F.array().cast("array<string>"))
    return stored.withColumn("contributing_features", listed)


def observe_scoring(results: DataFrame, observation: Observation) -> DataFrame:
    """Count results while they are written, without a pass of their own."""
    tiers = [F.count_if(F.col("is_anomalous") & (F.col("severity") == s)).alias(f"anomalies_{s.lower()}")
             for s, _ in SEVERITY_TIERS]
    return results.observe(
        observation, F.count("*").alias("vectors_scored"), F.count_if("is_anomalous").alias("anomalies"), *tiers)


def scoring_metrics(results: DataFrame) -> DataFrame:
    """Vectors scored and anomalies found, per severity."""
    return results.groupBy("severity").agg(
        F.count("*").alias("scored"), F.count_if("is_anomalous").alias("anomalies"))
