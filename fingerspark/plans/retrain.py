"""Training run: from stored vectors to a new model version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.functions.fixed import (
    MIN_TRAINING_ROWS,
    STD_FLOOR,
    SUBSAMPLE_SIZE,
    TREE_COUNT,
)
from fingerspark.operators.baseline import drift_score, fold_moments, global_baseline, image_moments, training_buffer
from fingerspark.operators.forest import (
    Model,
    full_trees,
    merged_samples,
    restore,
    train,
    train_on_samples,
    tree_samples,
)
from fingerspark.operators.registry import latest_model, registry_entry, version_of
from fingerspark.sources.schemas import FOREST_NODE, MODEL_REGISTRY, columns
from fingerspark.sources import states
from fingerspark.sources.tables import durable, empty_if_missing, release

VERSION = T.StructField("version", T.StringType())
BASELINE = columns("n bigint, mean array<double>, std array<double>")
REGISTRY, NODES, BASELINES = "model_registry", "forest_nodes", "global_baselines"
SAMPLES, MOMENTS, OVERALL = "tree_samples", "overall_moments", "all"
TREE_SAMPLE = columns("tree_id int, vector_id string, features array<double>, number bigint")
MOMENT = columns("image_name string, n bigint, mean array<double>, m2 array<double>")


def read_versions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A versioned model table; empty when no model has been stored."""
    own = {REGISTRY: T.StructType(MODEL_REGISTRY.fields[1:]), NODES: FOREST_NODE, BASELINES: BASELINE}
    schema = T.StructType(own[table].fields + [VERSION])
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as error:
        return empty_if_missing(spark, error, schema)


def _store(df: DataFrame, root: str, table: str, version: str) -> None:
    df.drop("version").write.mode("overwrite").parquet(f"{root}/{table}/version={version}")


def latest_baseline(spark: SparkSession, root: str) -> DataFrame:
    return latest_model(read_versions(spark, root, BASELINES)).drop("version")


def retrain(vectors: DataFrame, root: str, as_of: datetime, trees: int = TREE_COUNT,
            sample_size: int = SUBSAMPLE_SIZE, buffer_size: int | None = None,
            minimum: int = MIN_TRAINING_ROWS) -> Model | None:
    """Train on all vectors, or the newest ``buffer_size``, and store nodes, baseline and registry row under ``root``.

    None without enough data.
    """
    buffer = durable(training_buffer(vectors, buffer_size))
    trained = train(buffer, version_of(as_of), trees, sample_size, minimum=minimum)
    return publish(trained, durable(global_baseline(buffer)), root, as_of, trees) if trained else None


def keep_samples(vectors: DataFrame, root: str, batch_id: int, trees: int = TREE_COUNT,
                 sample_size: int = SUBSAMPLE_SIZE, one_hash: bool = False) -> None:
    """Add a batch of vectors to the samples and moments that the next model is trained on.

    Of the samples held so far only the largest number of each tree is looked at; of the batch
    only rows that a tree would keep are written.
    """
    spark = vectors.sparkSession
    buffer = durable(training_buffer(vectors))
    full = full_trees(stored_samples(spark, root, trees, sample_size, batch_id), sample_size)
    drawn = tree_samples(buffer, trees, sample_size, below=full, one_hash=one_hash)
    states.add(drawn, f"{root}/{SAMPLES}", batch_id, lambda s: merged_samples(s, trees, sample_size))
    overall = image_moments(buffer.withColumn("image_name", F.lit(OVERALL)))
    states.add(overall, f"{root}/{MOMENTS}", batch_id, fold_moments)
    release(buffer)


def stored_samples(spark: SparkSession, root: str, trees: int = TREE_COUNT, sample_size: int = SUBSAMPLE_SIZE,
                   before: int = 2**31 - 1) -> DataFrame:
    """The samples of all batches before ``before``."""
    held = states.added_before(spark, f"{root}/{SAMPLES}", before, TREE_SAMPLE)
    return merged_samples(held, trees, sample_size)


def retrain_on_samples(spark: SparkSession, root: str, as_of: datetime, trees: int = TREE_COUNT,
                       sample_size: int = SUBSAMPLE_SIZE, minimum: int = MIN_TRAINING_ROWS) -> Model | None:
    """Train on what :func:`keep_samples` has kept under ``root``, without reading the vectors again."""
    moments = durable(fold_moments(states.added_before(spark, f"{root}/{MOMENTS}", 2**31 - 1, MOMENT)))
    row = moments.first()
    trained = train_on_samples(stored_samples(spark, root, trees, sample_size), row["n"] if row else 0,
                               version_of(as_of), minimum=minimum)
    if trained is None:
        return None
    std = F.transform("m2", lambda m2: F.greatest(F.sqrt(m2 / F.col("n")), F.lit(STD_FLOOR)))
    return publish(trained, moments.select("n", "mean", std.alias("std")), root, as_of, trees)


def publish(trained: tuple[Model, DataFrame], baseline: DataFrame, root: str, as_of: datetime, trees: int) -> Model:
    """Store nodes, baseline and registry row of a model. The row is written last, so a version that shows there
    is complete. Drift is measured against the baseline of the model before."""
    model, nodes = trained
    spark, version = nodes.sparkSession, version_of(as_of)
    older = read_versions(spark, root, BASELINES).filter(f"version < '{version}'")
    drift = drift_score(baseline, latest_model(older).drop("version"))
    entry = durable(registry_entry(spark, model, drift, as_of, trees=trees))
    _store(nodes, root, NODES, version)
    _store(baseline, root, BASELINES, version)
    _store(entry, root, REGISTRY, version)
    return model


def current_model(spark: SparkSession, root: str, known: Model | None = None) -> Model | None:
    """The newest stored model; ``known`` is handed back while it is still the newest."""
    row = latest_model(read_versions(spark, root, REGISTRY)).first()
    if row is None:
        return None
    if known is not None and known.version == row["version"]:
        return known
    return restore(spark, read_versions(spark, root, NODES), row)
