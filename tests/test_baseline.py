from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fingerspark.functions.fixed import FEATURE_NAMES
from fingerspark.operators import baseline
from fingerspark.operators.ordered import ordinal, running_totals
from fingerspark.operators.paging import page_envelope, page_rows

T0 = datetime(2026, 1, 1)


def vectors(spark, rows):
    """Vectors of (image, array of 18) at half-minute steps."""
    data = [(f"v{i:04d}", image, T0 + timedelta(seconds=30 * i), [float(x) for x in values])
            for i, (image, values) in enumerate(rows)]
    return spark.createDataFrame(data, "vector_id string, image_name string, window_end timestamp, features array<double>")


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    return [("hot" if i % 3 else f"img{i % 4}", rng.normal(5, 2, 18)) for i in range(90)]


def test_running_totals_match_a_window(spark):
    """One key holds most rows; totals equal a plain running sum whatever the slices."""
    rows = [("hot" if i % 5 else f"k{i}", i // 3, i, float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id int, x double").repartition(7)
    got = running_totals(df, ["k"], ["t", "id"], {"n": F.lit(1).cast("bigint"), "s": F.col("x")})
    seen, total, expected = {}, {}, {}
    for k, _, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k], total[k] = seen.get(k, 0) + 1, total.get(k, 0.0) + x
        expected[i] = (seen[k], total[k])
    assert {r.id: (r.n, r.s) for r in got.collect()} == expected


def test_a_hot_key_is_cut_into_slices(spark):
    """At sizes where partitions are not merged, one key spans several of them."""
    df = spark.range(20_000).withColumn("k", F.lit("hot"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = df.repartitionByRange(4, "k", "id").select(F.spark_partition_id()).distinct().count()
        n = ordinal(df, ["k"], ["id"]).filter("ordinal != id + 1").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sliced == 4 and n == 0


def test_ordinal_without_keys(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 37) % 500)
    got = ordinal(df, [], [F.desc("v")])
    assert got.filter("ordinal != 500 - v").count() == 0


def test_pages_are_slices_of_the_order(spark):
    minutes = F.make_dt_interval(mins=(F.col("id") * 7 % 50 * 20).cast("int"))
    base = F.lit("2026-01-01 00:30:00")
    for flavour in ("timestamp", "timestamp_ntz"):
        df = spark.range(300).withColumn("at", base.cast(flavour) + minutes)
        df = df.withColumn("at", F.when(F.col("id") % 9 != 0, F.col("at")))      # rows without a time come last
        rows = df.orderBy(F.desc_nulls_last("at"), "id").collect()
        for page in (0, 3, 13, 14, 15):
            assert page_rows(df, "at", "id", page, 20).collect() == rows[20 * page:20 * page + 20]


def test_envelope(spark):
    assert tuple(page_envelope(spark.range(0), 0, 20).first()) == (0, 20, 0, 0, False)
    assert tuple(page_envelope(spark.range(41), 1, 20).first()) == (1, 20, 41, 3, True)
    assert tuple(page_envelope(spark.range(401), 0, 300).first()) == (0, 300, 401, 2, True)


def test_buffer_keeps_the_newest(spark):
    rows = [("a", [float("nan")] + [1.0] * 17) for _ in range(10)] + [("a", [1.0] * 17)]
    kept = baseline.training_buffer(vectors(spark, rows), size=4).orderBy("vector_id").collect()
    assert [r.vector_id for r in kept] == ["v0006", "v0007", "v0008", "v0009"]
    assert kept[0].features[0] == 0.0
    assert baseline.training_buffer(vectors(spark, rows), size=100).count() == 10


def test_buffer_breaks_ties_by_id(spark):
    df = vectors(spark, [("a", [1.0] * 18)] * 6).withColumn("window_end", F.lit(T0))
    kept = baseline.training_buffer(df, size=2).collect()
    assert sorted(r.vector_id for r in kept) == ["v0000", "v0001"]
    assert baseline.training_buffer(df).count() == 6


def test_global_baseline(spark, sample):
    x = np.array([v for _, v in sample])
    row = baseline.global_baseline(vectors(spark, sample)).first()
    assert np.allclose(row["mean"], x.mean(0)) and np.allclose(row["std"], x.std(0)) and row.n == 90
    flat = baseline.global_baseline(vectors(spark, [("a", [1.0] * 18)] * 3)).first()
    assert flat["std"] == [1e-8] * 18


def test_image_baseline_and_merge(spark, sample):
    df = vectors(spark, sample + [("single", [1.0] * 18), (None, [9.0] * 18), ("", [9.0] * 18)])
    whole = {r.image_name: r for r in baseline.image_baseline(df).collect()}
    x = np.array([v for image, v in sample if image == "hot"])
    assert np.allclose(whole["hot"]["mean"], x.mean(0)) and np.allclose(whole["hot"]["std"], x.std(0, ddof=1))
    assert whole["single"]["std"] is None and None not in whole and "" not in whole
    parts = [baseline.image_moments(df.filter(c)) for c in ("vector_id < 'v0040'", "vector_id >= 'v0040'")]
    merged = {r.image_name: r for r in baseline.baseline_of_moments(baseline.merge_moments(*parts)).collect()}
    assert merged.keys() == whole.keys()
    for image, row in whole.items():
        assert merged[image].n == row.n and np.allclose(merged[image]["mean"], row["mean"])
        assert (row["std"] is None) == (merged[image]["std"] is None)
        assert row["std"] is None or np.allclose(merged[image]["std"], row["std"])


def test_online_baseline_includes_the_row_itself(spark, sample):
    got = {r.vector_id: r for r in baseline.online_image_baseline(vectors(spark, sample)).collect()}
    seen = {}
    for i, (image, values) in enumerate(sample):
        seen.setdefault(image, []).append(values)
        x, row = np.array(seen[image]), got[f"v{i:04d}"]
        assert row.n == len(x) and np.allclose(row["mean"], x.mean(0))
        if len(x) > 1:
            assert np.allclose(row["std"], x.std(0, ddof=1))
        else:
            assert row["std"] is None


def test_drift(spark, sample):
    old, new = vectors(spark, sample[:40]), vectors(spark, sample[40:])
    a, b = (np.array([v for _, v in part]) for part in (sample[:40], sample[40:]))
    expected = np.mean(np.abs(b.mean(0) - a.mean(0)) / a.std(0))
    got = baseline.drift_score(baseline.global_baseline(new), baseline.global_baseline(old)).first()[0]
    assert got == pytest.approx(expected)
    nothing = baseline.global_baseline(old).filter("n < 0")
    assert baseline.drift_score(baseline.global_baseline(new), nothing).first()[0] == 0.0


def contributors(df, **kwargs):
    return {r.vector_id: r.contributing_features for r in baseline.contributing_features(df, **kwargs).collect()}


def test_contributors_fall_back(spark, sample):
    falling = 10.0 - np.arange(18)
    df = vectors(spark, sample + [("single", falling), (None, falling), ("hot", [1.0] * 17)])
    images, overall = baseline.image_baseline(df.filter("size(features) = 18")), baseline.global_baseline(
        df.filter("size(features) = 18"))
    raw_top = [FEATURE_NAMES[i] for i in (0, 1, 2, 3, 17)]
    assert contributors(df)["v0090"] == raw_top
    lenient = contributors(df, images=images, overall=overall)
    assert lenient["v0090"] == lenient["v0091"] != raw_top
    strict = contributors(df, images=images, overall=overall, image_blocks_overall=True)
    assert strict["v0090"] == raw_top and strict["v0091"] == lenient["v0091"]
    assert lenient["v0092"] == [] and all(len(v) == 5 for k, v in lenient.items() if k != "v0092")


def test_equal_deviations_keep_schema_order(spark):
    assert contributors(vectors(spark, [("a", [-1.0] * 18)]))["v0000"] == list(FEATURE_NAMES[:5])
