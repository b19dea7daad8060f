"""Model registry: what was trained when, on what, and how far behaviour had moved."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    CONTAMINATION,
    FEATURE_COUNT,
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
    MIN_TRAINING_ROWS,
    SEVERITY_TIERS,
    TREE_COUNT,
)
from fingerspark.functions.timing import instant
from fingerspark.operators.forest import Model
from fingerspark.sources.schemas import MODEL_REGISTRY, conform

# Fixed value: how the kind of model is called where it is described.
MODEL_TYPE = "IsolationForest"


def version_of(as_of: datetime) -> str:
    return as_of.strftime("%Y%m%d%H%M%S")


def registry_entry(spark: SparkSession, model: Model, drift: DataFrame, trained_at: str | datetime | Column,
                   contamination: float = CONTAMINATION, trees: int = TREE_COUNT) -> DataFrame:
    """The registry row of a model; ``drift`` is the one-row result of ``drift_score``."""
    return conform(drift.select(
        F.lit(model.version).alias("version"),
        F.lit(model.samples).alias("samples"),
        F.lit(FEATURE_COUNT).alias("features"),
        F.lit(FEATURE_SCHEMA_VERSION).alias("schema_version"),
        F.round("drift_score", 6).alias("drift_score"),
        instant(trained_at).alias("trained_at"),
        F.lit(contamination).alias("contamination"),
        F.lit(trees).alias("tree_count"),
        F.lit(model.offset).alias("offset"),
    ), MODEL_REGISTRY)


def latest_model(registry: DataFrame) -> DataFrame:
    """The row with the greatest version."""
    return registry.orderBy(F.desc("version")).limit(1)


def registry_listing(registry: DataFrame) -> DataFrame:
    """All models, newest first, marked with the current one and the registry size.

    The two figures come from one aggregate joined as scalar subqueries.
    """
    current = registry.agg(F.max("version")).scalar()
    total = registry.agg(F.count("*")).scalar()
    return registry.withColumns({
        "is_current": F.col("version") == current, "registry_size": total}).orderBy(F.desc("version"))


def model_info(registry: DataFrame, buffer: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """The current model with registry size and the thresholds in force.

    Of a stored registry, also what the model is; of the vectors to train on and of the image baselines,
    where they are given, how many there are.
    """
    tiers = {f"threshold_{name.lower()}": F.lit(floor) for name, floor in SEVERITY_TIERS}
    sizes = {"training_buffer_size": buffer, "image_baselines_tracked": images}
    stored = {"model_type": F.lit(MODEL_TYPE), "feature_names": F.lit(",".join(FEATURE_NAMES)),
              "n_estimators": F.col("tree_count")} if "tree_count" in registry.columns else {}
    return latest_model(registry).withColumns({
        **tiers, **stored,
        "min_training_samples": F.lit(MIN_TRAINING_ROWS),
        "registry_size": registry.agg(F.count("*")).scalar(),
        **{name: rows.agg(F.count("*")).scalar() for name, rows in sizes.items() if rows is not None},
    })
