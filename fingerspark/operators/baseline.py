"""Baselines of feature vectors, drift between them, and deviation-based explanations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    FEATURE_COUNT,
    FEATURE_NAMES,
    STD_FLOOR,
    TOP_FEATURES,
    VARIANCE_FLOOR,
)
from fingerspark.functions.scoring import clean_vector, has_vector_length
from fingerspark.functions.timing import instant
from fingerspark.operators.ordered import ordinal
from fingerspark.sources.tables import durable

_DIMENSIONS = range(FEATURE_COUNT)


def training_buffer(vectors: DataFrame, size: int | None = None,
                    since: str | datetime | Column | None = None) -> DataFrame:
    """The vectors of full length to train on, cleaned of NaN and infinities.

    All of them by default. ``since`` leaves out windows that end before it; ``size``
    keeps the newest so many, rows of one window end going by ``vector_id``. For that,
    counts per window end find the end from which ``size`` rows are reached; everything
    older is filtered at the scan, and what is left is numbered in slices.
    """
    usable = vectors.filter(has_vector_length(F.col("features")))
    if since is not None:
        usable = usable.filter(F.col("window_end") >= instant(since).cast(vectors.schema["window_end"].dataType))
    if size is not None:
        flavour = vectors.schema["window_end"].dataType
        ends = usable.groupBy("window_end").count().orderBy(F.desc("window_end")).limit(size)
        reached = ends.withColumn("seen", F.sum("count").over(Window.orderBy(F.desc("window_end"))))
        cutoff = reached.filter(F.col("seen") >= size).agg(F.max("window_end").cast("string").alias("end")).first()
        if cutoff["end"] is not None:
            recent = usable.filter(F.col("window_end") >= F.lit(cutoff["end"]).cast(flavour))
            order = [F.desc("window_end"), F.col("vector_id")]
            usable = ordinal(recent, [], order, "_nth").filter(F.col("_nth") <= size).drop("_nth")
    return usable.withColumn("features", clean_vector(F.col("features")))


def _per_dimension(function) -> Column:
    return F.array(*[function(F.get("features", F.lit(i))) for i in _DIMENSIONS])


def global_baseline(vectors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-dimension ``mean`` and population ``std`` arrays and the count ``n``: one row, or
    one per value of ``by``.

    All dimensions are aggregated side by side in one pass, without exploding vectors.
    """
    return vectors.groupBy(*by).agg(
        F.count("*").alias("n"),
        _per_dimension(F.avg).alias("mean"),
        _per_dimension(lambda x: F.greatest(F.stddev_pop(x), F.lit(STD_FLOOR))).alias("std"),
    )


def image_moments(vectors: DataFrame) -> DataFrame:
    """Per image: count, mean and summed squared deviation ``m2`` of every dimension."""
    named = vectors.filter(F.coalesce(F.col("image_name"), F.lit("")) != "")
    return named.groupBy("image_name").agg(
        F.count("*").alias("n"),
        _per_dimension(F.avg).alias("mean"),
        _per_dimension(lambda x: F.var_pop(x) * F.count("*")).alias("m2"),
    )


def merge_moments(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Moments of the union of two disjoint sets of vectors, per image."""
    old = state.select("image_name", *[F.col(c).alias(f"_{c}") for c in ("n", "mean", "m2")])
    joined = old.join(delta, "image_name", "full_outer")
    share = F.col("n") / (F.col("n") + F.col("_n"))
    mean = F.zip_with("_mean", "mean", lambda a, b: a + (b - a) * share)
    spread = F.zip_with("_mean", "mean", lambda a, b: (b - a) * (b - a) * F.col("_n") * share)
    within = F.zip_with("_m2", "m2", lambda a, b: a + b)
    # New names first: inside a lambda, a name that the same select defines would win.
    merged = joined.select(
        "image_name",
        (F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("all_n"),
        F.coalesce(mean, "mean", "_mean").alias("all_mean"),
        F.coalesce(F.zip_with(within, spread, lambda a, b: a + b), "m2", "_m2").alias("all_m2"),
    )
    return merged.withColumnsRenamed({"all_n": "n", "all_mean": "mean", "all_m2": "m2"})


def merged_moments(a: Column, b: Column) -> Column:
    """The moments (struct of n, mean and m2) of the union of two disjoint sets."""
    n = a["n"] + b["n"]
    share = b["n"] / n
    gap = F.zip_with(a["mean"], b["mean"], lambda x, y: y - x)
    within = F.zip_with(a["m2"], b["m2"], lambda x, y: x + y)
    return F.struct(
        n.alias("n"), F.zip_with(a["mean"], gap, lambda x, d: x + d * share).alias("mean"),
        F.zip_with(within, gap, lambda w, d: w + d * d * a["n"] * share).alias("m2"))


def all_merged(parts: Column) -> Column:
    """The moments of all sets of an array; null where it is empty."""
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    return F.when(F.size(parts) > 0, F.aggregate(rest, F.get(parts, F.lit(0)), merged_moments))


def fold_moments(moments: DataFrame) -> DataFrame:
    """Moments of the union of disjoint sets of vectors, per image, from a few rows of moments of each.

    The rows of an image are merged one by one in a fixed order. They are as many as sets were
    stored, not as vectors.
    """
    parts = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    return moments.groupBy("image_name").agg(all_merged(parts).alias("all")).select(
        "image_name", "all.n", "all.mean", "all.m2")


def baseline_of_moments(moments: DataFrame) -> DataFrame:
    """Per image: count, mean and sample std arrays; ``std`` is null below two vectors."""
    n = F.col("n")
    std = F.transform("m2", lambda m2: F.sqrt(F.greatest(m2 / (n - 1), F.lit(VARIANCE_FLOOR))))
    return moments.select("image_name", "n", "mean", F.when(n > 1, std).alias("std"))


def image_baseline(vectors: DataFrame) -> DataFrame:
    """Baseline of every image over ``vectors``."""
    return baseline_of_moments(image_moments(vectors))


def baseline_rows(baseline: DataFrame) -> DataFrame:
    """A baseline in long form: one row per dimension."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    keys = [c for c in baseline.columns if c not in ("mean", "std")]
    return baseline.select(*keys, "std", F.posexplode("mean").alias("pos", "mean")).select(
        *keys, "pos", F.get(names, F.col("pos")).alias("feature"), "mean",
        F.get("std", F.col("pos")).alias("std"))


def running_moments(vectors: DataFrame) -> DataFrame:
    """Per vector, count, mean and summed squared deviations of its image's vectors of one slice so far.

    The vectors are cut into slices by image and time, so an image of any size is many of them; a slice is
    read once in order, a batch at a time, and ``slice`` tells the order of the slices.
    """
    ordered = vectors.repartitionByRange("image_name", "window_end", "vector_id").sortWithinPartitions(
        "image_name", "window_end", "vector_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        image, held = None, (0, 0.0, 0.0)
        for batch in batches:
            for name, rows in batch.groupby("image_name", sort=True):
                if name != image:
                    image, held = name, (0, 0.0, 0.0)
                x = np.stack(rows["features"].to_numpy()).astype("float64")
                count = np.arange(1, len(x) + 1)[:, None]
                centre = x.mean(axis=0)
                sums, squares = np.cumsum(x - centre, axis=0), np.cumsum((x - centre) ** 2, axis=0)
                mean, m2 = centre + sums / count, np.maximum(squares - sums * sums / count, 0.0)
                n = held[0] + count
                gap = mean - held[1]
                m2 = held[2] + m2 + gap * gap * held[0] * count / n
                mean = held[1] + gap * count / n
                held = (int(n[-1, 0]), mean[-1], m2[-1])
                yield pd.DataFrame({
                    "vector_id": rows["vector_id"], "image_name": name, "window_end": rows["window_end"], "slice": number,
                    "n": n[:, 0], "mean": list(mean), "m2": list(m2)})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return ordered.mapInPandas(run, f"""vector_id {kinds["vector_id"]}, image_name string, window_end {kinds["window_end"]},
        slice int, n bigint, mean array<double>, m2 array<double>""")


def online_image_baseline(vectors: DataFrame) -> DataFrame:
    """Per vector, the baseline of its image after all vectors up to and including it.

    A prefix scan of moments: running ones inside slices, and for each slice and image the merged
    ones of the slices before. Only one row per slice and image crosses between slices. Moments
    are merged and not subtracted, so no precision is lost to cancellation. Vectors of wrong length
    have no part.
    """
    usable = vectors.filter((F.coalesce(F.col("image_name"), F.lit("")) != "") & has_vector_length(F.col("features")))
    local = durable(running_moments(usable.select("vector_id", "image_name", "window_end", "features")))
    whole = local.groupBy("image_name", "slice").agg(F.max(F.struct("n", "mean", "m2")).alias("whole"))
    earlier = Window.partitionBy("image_name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("image_name", "slice", all_merged(F.collect_list("whole").over(earlier)).alias("before"))
    own = F.struct("n", "mean", "m2")
    joined = local.join(before, ["image_name", "slice"]).select(
        "vector_id", "image_name", "window_end",
        F.when(F.col("before").isNull(), own).otherwise(merged_moments(F.col("before"), own)).alias("all"))
    flat = joined.select("vector_id", "image_name", "window_end", "all.*")
    std = F.transform("m2", lambda m2: F.sqrt(F.greatest(m2 / (F.col("n") - 1), F.lit(VARIANCE_FLOOR))))
    return flat.select("vector_id", "image_name", "window_end", "n", "mean", F.when(F.col("n") > 1, std).alias("std"))


def drift_score(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: mean over dimensions of |mean - previous mean| / previous std, 0 without previous."""
    old = baseline_rows(previous).select("pos", F.col("mean").alias("old_mean"), F.col("std").alias("old_std"))
    shift = F.abs(F.col("mean") - F.col("old_mean")) / F.col("old_std")
    return (baseline_rows(current).join(old, "pos")
            .agg(F.coalesce(F.avg(shift), F.lit(0.0)).alias("drift_score")))


def drift_history(baselines: DataFrame, version: str = "version") -> DataFrame:
    """Drift of every version's baseline against the version before, 0 for the first.

    One row per model version enters the ordered pass.
    """
    previous = Window.orderBy(version)
    paired = baselines.withColumns({
        "_mean": F.lag("mean").over(previous), "_std": F.lag("std").over(previous)})
    shifts = F.transform("mean", lambda m, i: F.abs(m - F.get("_mean", i)) / F.get("_std", i))
    total = F.aggregate(shifts, F.lit(0.0), lambda acc, s: acc + s)
    return paired.withColumn(
        "drift_score", F.coalesce(total / F.size("mean"), F.lit(0.0))).drop("_mean", "_std")


def _top_names(deviations: Column, top: int) -> Column:
    """Names of the largest deviations; equal ones keep the schema order."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    ranked = F.transform(deviations, lambda d, i: F.struct((-d).alias("d"), i.alias("i")))
    first = F.slice(F.array_sort(ranked), 1, top)
    return F.transform(first, lambda r: F.get(names, r["i"]))


def contributing_features(vectors: DataFrame, images: DataFrame | None = None,
                          overall: DataFrame | None = None, top: int = TOP_FEATURES,
                          image_blocks_overall: bool = False) -> DataFrame:
    """Add ``contributing_features``: the ``top`` dimensions furthest from their baseline.

    The baseline is the one of the vector's image, else the overall one, else zero mean
    and unit deviation (the raw magnitude). With ``image_blocks_overall`` an image seen
    only once does not fall back to the overall baseline but to the raw magnitude.
    Vectors of a wrong length get an empty list.

    The image join carries no hint: Spark broadcasts the per-image rows while they are
    below its threshold, and splits the skewed image otherwise. Pass stored baselines, so
    that their true size is known when the join is planned.
    """
    extended = vectors
    mean, std = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
    if images is not None:
        known = images.select("image_name", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
        extended = extended.join(known, "image_name", "left")
        usable = F.col("_std").isNotNull()
        mean, std = F.when(usable, F.col("_mean")), F.when(usable, F.col("_std"))
    if overall is not None:
        whole = overall.select(F.struct("mean", "std").alias("b"))
        open_to_overall = F.lit(True)
        if image_blocks_overall and images is not None:
            open_to_overall = F.col("_mean").isNull()
        fallback = F.when(std.isNull() & open_to_overall, whole.scalar())
        mean = F.coalesce(mean, fallback["mean"])
        std = F.coalesce(std, fallback["std"])
    extended = extended.withColumns({"_m": mean, "_s": std})
    deviation = F.transform(
        F.col("features"),
        lambda x, i: F.abs(x - F.coalesce(F.get("_m", i), F.lit(0.0)))
        / F.coalesce(F.get("_s", i), F.lit(1.0)),
    )
    no_names = F.array().cast("array<string>")
    chosen = F.when(has_vector_length(F.col("features")), _top_names(deviation, top)).otherwise(no_names)
    return extended.withColumn("contributing_features", chosen).select(
        *vectors.columns, "contributing_features")
