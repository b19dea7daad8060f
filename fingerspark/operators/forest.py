"""Isolation Forest on Spark: trees are grown as grouped tasks and kept as a node table."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import ceil, log2
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    CONTAMINATION,
    FEATURE_COUNT,
    FOREST_SEED,
    MIN_TRAINING_ROWS,
    SUBSAMPLE_SIZE,
    TREE_COUNT,
)
from fingerspark.functions.scoring import clean_vector
from fingerspark.sources.schemas import FOREST_NODE
from fingerspark.sources.tables import durable

# The two task functions below travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329
LEAF = -1
# Draws are below this. A tree's limit lets in so many standard deviations of rows too many,
# so that it practically never gets too few.
DRAWS = 1 << 32
SPARE_DEVIATIONS = 7
# Decimals of the scores among which the offset is found.
OFFSET_DECIMALS = 6


_BROADCASTS: WeakKeyDictionary = WeakKeyDictionary()


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` rows of a random binary tree."""
    n = np.asarray(n, dtype="float64")
    large = np.maximum(n, 3.0)
    value = 2.0 * (np.log(large - 1.0) + EULER_GAMMA) - 2.0 * (large - 1.0) / large
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def height_limit(sample_size: int) -> int:
    return ceil(log2(max(sample_size, 2)))


def _bits(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def _digest(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def with_draws(vectors: DataFrame, seed: int) -> DataFrame:
    """Add ``_a`` and ``_b``, from which a row's number for tree t is ``(_a + t * _b) % DRAWS``.

    One hash serves all trees: a row's numbers are uniform, and those of two trees independent.
    Those of three are not: of the rows that two neighbouring trees take, the next one takes nearly half.
    """
    digest = _digest(seed, "vector_id")
    return vectors.withColumns({"_a": _bits(digest, 1), "_b": _bits(digest, 9).bitwiseOR(F.lit(1))})


def tree_samples(training: DataFrame, trees: int = TREE_COUNT, sample_size: int = SUBSAMPLE_SIZE,
                 seed: int = FOREST_SEED, rows: int | None = None, below: DataFrame | None = None,
                 one_hash: bool = False) -> DataFrame:
    """(tree_id, vector_id, features, number): a subsample without replacement for every tree.

    A row draws a number for each tree and joins those where it is below a limit that
    lets in somewhat more than ``sample_size`` rows; of these a tree keeps the rows of the
    smallest numbers. So one scan decides, and hardly more rows move than are used. With
    fewer rows than ``sample_size`` a tree takes all. ``rows`` is the number of training
    rows where it is known already.

    Samples of disjoint sets merge (:func:`merged_samples`). ``below`` (tree_id, number) names numbers from
    which on no row would be kept in such a merger.

    Every tree draws by a hash of its own. With ``one_hash`` all of a row's numbers come of one
    (:func:`with_draws`), which is cheaper.
    """
    counted = F.lit(rows) if rows is not None else training.agg(F.count("*").alias("n")).scalar()
    wanted = sample_size + SPARE_DEVIATIONS * sample_size ** 0.5
    limit = F.lit(float(DRAWS)) * F.lit(wanted) / counted.cast("double")
    limited = training.select("vector_id", "features").withColumn("_limit", F.coalesce(limit, F.lit(0.0)))
    limited = with_draws(limited, seed) if one_hash else limited
    number = (F.col("_a") + F.col("tree_id") * F.col("_b")) % DRAWS if one_hash else _bits(_digest(seed, "tree_id", "vector_id"), 1)
    # Generated and filtered in one compiled loop; rows that join no tree are never made.
    numbered = limited.select("*", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree_id")).withColumn(
        "number", number)
    drawn = numbered.filter(F.col("number") < F.col("_limit")).select("tree_id", "vector_id", "features", "number")
    if below is not None:
        limits = below.select("tree_id", F.col("number").alias("_from"))
        drawn = drawn.join(F.broadcast(limits), "tree_id", "left").filter("_from IS NULL OR number < _from").drop("_from")
    return merged_samples(drawn, trees, sample_size)


def merged_samples(samples: DataFrame, trees: int = TREE_COUNT, sample_size: int = SUBSAMPLE_SIZE) -> DataFrame:
    """For each tree, the rows of the smallest numbers of all that are given."""
    # A given number of partitions, as the sizes say nothing of the work per tree. The ranks and
    # the growing of the trees use them as they are.
    parts = min(trees, 4 * samples.sparkSession.sparkContext.defaultParallelism)
    first = Window.partitionBy("tree_id").orderBy("number", "vector_id")
    return (samples.repartition(parts, "tree_id").withColumn("nth", F.row_number().over(first))
            .filter(F.col("nth") <= sample_size).select("tree_id", "vector_id", "features", "number"))


def full_trees(samples: DataFrame, sample_size: int = SUBSAMPLE_SIZE) -> DataFrame:
    """(tree_id, number) of the trees that have all their rows: what is not below enters no more."""
    held = samples.groupBy("tree_id").agg(F.count("*").alias("rows"), F.max("number").alias("number"))
    return held.filter(F.col("rows") >= sample_size).select("tree_id", "number")


def _grow(key: tuple, rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Grow one tree, a level at a time: every open node of a level is split together.

    Nodes are numbered as in a heap (children of i are 2i and 2i+1, the root is 1).
    """
    tree_id = int(key[0])
    rows = rows.sort_values("vector_id")
    x = np.stack(rows["features"].to_numpy()).astype("float64")
    limit = height_limit(len(x))
    rng = np.random.default_rng([seed, tree_id])
    node = np.ones(len(x), dtype="int64")
    found = []
    for depth in range(limit + 1):
        order = np.argsort(node, kind="stable")
        node, x = node[order], x[order]
        ids, starts, sizes = np.unique(node, return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        varying = high > low
        # A uniform key per dimension, kept only where the node varies: the largest key
        # is a uniform choice among the varying dimensions.
        keys = np.where(varying, rng.random(varying.shape), -1.0)
        feature = keys.argmax(axis=1)
        at = np.arange(len(ids))
        lo, hi = low[at, feature], high[at, feature]
        threshold = lo + rng.random(len(ids)) * (hi - lo)
        # Guard against a threshold rounded onto the minimum, which would not split.
        threshold = np.where(threshold > lo, threshold, hi)
        leaf = ~varying.any(axis=1) | (depth == limit)
        found.append(pd.DataFrame({
            "tree_id": tree_id, "node_id": ids, "depth": depth, "size": sizes,
            "feature": np.where(leaf, LEAF, feature), "threshold": np.where(leaf, 0.0, threshold),
        }))
        if leaf.all():
            break
        position = np.repeat(at, sizes)
        right = x[np.arange(len(x)), feature[position]] >= threshold[position]
        going_on = ~leaf[position]
        node, x = (2 * node + right)[going_on], x[going_on]
    return pd.concat(found).astype({
        "tree_id": "int32", "node_id": "int32", "depth": "int32", "size": "int32", "feature": "int32"})


def grow_forest(samples: DataFrame, seed: int = FOREST_SEED) -> DataFrame:
    """Node table of the forest. A group is one tree's subsample, at most its fixed size."""
    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _grow(key, rows, seed)

    return samples.select("tree_id", "vector_id", "features").groupBy("tree_id").applyInPandas(grow, FOREST_NODE)


@dataclass(frozen=True, eq=False)
class Forest:
    """A grown forest ready to score: one row of node arrays per tree, by heap number."""

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    sample_size: int


def path_scores(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, length: np.ndarray,
                sample_size: int) -> np.ndarray:
    """Anomaly score in (0, 1] of every row of ``x``: 2^(-mean path / expected path).

    All rows of a batch walk down a tree together, one numpy step per level.
    """
    everyone = np.arange(len(x))
    path = np.zeros(len(x))
    for split_by, cut, depth_at in zip(feature, threshold, length):
        row, node = everyone, np.ones(len(x), dtype="int64")
        while len(row):
            split = split_by[node]
            ended = split == LEAF
            path[row[ended]] += depth_at[node[ended]]
            row, node, split = row[~ended], node[~ended], split[~ended]
            node = 2 * node + (x[row, split] >= cut[node])
    expected = max(float(average_path(sample_size)), np.finfo(float).tiny)
    return np.exp2(-path / len(feature) / expected)


def load_forest(nodes: DataFrame) -> Forest:
    """Bring a node table to the driver as arrays.

    Its size is fixed by the model, not by the data: trees x (2 x sample size) nodes.
    """
    table = nodes.select(*FOREST_NODE.names).toPandas()
    trees = np.sort(table["tree_id"].unique())
    sample_size = int(table.loc[table["node_id"] == 1, "size"].max())
    shape = (len(trees), 2 ** (height_limit(sample_size) + 1))
    feature = np.full(shape, LEAF, dtype="int64")
    threshold, length = np.zeros(shape), np.zeros(shape)
    at = np.searchsorted(trees, table["tree_id"]), table["node_id"].to_numpy()
    feature[at], threshold[at] = table["feature"], table["threshold"]
    length[at] = table["depth"] + average_path(table["size"])
    return Forest(feature, threshold, length, sample_size)


def _shared(spark: SparkSession, forest: Forest) -> Broadcast:
    """The broadcast of a forest, made once and given up when the forest is."""
    context = spark.sparkContext
    known = _BROADCASTS.get(forest)
    if known is None or known[0] != context.applicationId:
        parts = (forest.feature, forest.threshold, forest.length, forest.sample_size)
        known = _BROADCASTS[forest] = (context.applicationId, context.broadcast(parts))
    return known[1]


def forest_scores(vectors: DataFrame, forest: Forest) -> DataFrame:
    """Add ``forest_score``; the forest is broadcast, vectors stay where they are."""
    shared = _shared(vectors.sparkSession, forest)

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        if features.empty:
            return pd.Series(dtype="float64")
        return pd.Series(path_scores(np.stack(features.to_numpy()), *shared.value))

    usable = F.size("features") == FEATURE_COUNT
    cleaned = F.when(usable, clean_vector(F.col("features"))).otherwise(
        F.array(*[F.lit(0.0)] * FEATURE_COUNT))
    return vectors.withColumn("forest_score", F.when(usable, score(cleaned)))


def contamination_offset(scores: DataFrame, contamination: float = CONTAMINATION,
                         score: str = "forest_score") -> DataFrame:
    """One row: the score that the given share of the training rows exceeds.

    Scores count at six decimals, which leaves at most a million different ones of which
    the exact percentile is found from counts, whatever the number of rows.
    """
    counts = scores.groupBy(F.round(score, OFFSET_DECIMALS).alias("s")).agg(F.count(score).alias("n"))
    return counts.filter("s is not null").agg(
        F.percentile("s", F.lit(1.0 - contamination), F.col("n")).alias("offset"))


@dataclass(frozen=True)
class Model:
    """A trained model: its forest and the offset that centres decisions on 0."""

    version: str
    forest: Forest
    offset: float
    samples: int


def train(training: DataFrame, version: str, trees: int = TREE_COUNT,
          sample_size: int = SUBSAMPLE_SIZE, seed: int = FOREST_SEED,
          contamination: float = CONTAMINATION,
          minimum: int = MIN_TRAINING_ROWS) -> tuple[Model, DataFrame] | None:
    """Fit a forest on the training buffer; None when it holds fewer than ``minimum`` rows.

    Give it a stored table, as it is read several times. Returns the model and its nodes.
    """
    samples = training.count()
    if samples < minimum:
        return None
    return fitted(tree_samples(training, trees, sample_size, seed, samples), training, samples, version, seed, contamination)


def train_on_samples(samples: DataFrame, rows: int, version: str, seed: int = FOREST_SEED,
                     contamination: float = CONTAMINATION,
                     minimum: int = MIN_TRAINING_ROWS) -> tuple[Model, DataFrame] | None:
    """Fit a forest on samples that were kept batch by batch of ``rows`` vectors.

    Its trees are those that all the vectors would give. The offset is that of the vectors in the
    samples: at most trees times sample size of them.
    """
    if rows < minimum:
        return None
    held = durable(samples)
    return fitted(held, held.dropDuplicates(["vector_id"]), rows, version, seed, contamination)


def fitted(samples: DataFrame, training: DataFrame, rows: int, version: str, seed: int,
           contamination: float) -> tuple[Model, DataFrame]:
    nodes = durable(grow_forest(samples, seed))
    forest = load_forest(nodes)
    # Scoring costs far more per byte than a scan, so the few rows are spread over all cores.
    spread = training.repartition(training.sparkSession.sparkContext.defaultParallelism)
    offset = contamination_offset(forest_scores(spread, forest), contamination).first()["offset"]
    return Model(version, forest, offset, rows), nodes


def raw_decision(vectors: DataFrame, model: Model) -> DataFrame:
    """Add ``raw_score``: forest score less the model's offset, above 0 when anomalous."""
    return forest_scores(vectors, model.forest).withColumn(
        "raw_score", F.col("forest_score") - F.lit(model.offset))


def restore(spark: SparkSession, nodes: DataFrame, registry_row) -> Model:
    """Model of a registry row from the stored node table."""
    own = nodes.filter(F.col("version") == registry_row["version"])
    return Model(registry_row["version"], load_forest(own), registry_row["offset"], registry_row["samples"])
