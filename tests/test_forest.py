from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fingerspark.operators import baseline, evaluation, forest, registry, results
from fingerspark.plans.model_queries import FIXED_FOREST
from fingerspark.plans.retrain import (
    BASELINES,
    NODES,
    REGISTRY,
    current_model,
    keep_samples,
    read_versions,
    retrain,
    retrain_on_samples,
    stored_samples,
)
from fingerspark.sources.schemas import FOREST_NODE
from fingerspark.sources.tables import durable

SCHEMA = ("vector_id string, container_id string, image_name string, window_start timestamp, "
          "window_end timestamp, total_events bigint, features array<double>")


def cloud(spark, n=400, outliers=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 18))
    x[:outliers] += 8
    at = datetime(2026, 1, 1)
    rows = [(f"v{i:05d}", f"c{i % 3}", "img", at, at, 10, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def trained(spark):
    data = durable(cloud(spark))
    model, nodes = forest.train(data, "20260101000000", trees=40, sample_size=128)
    return data, model, nodes


def test_average_path():
    assert forest.average_path(np.array([0, 1, 2])).tolist() == [0, 0, 1]
    assert forest.average_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)
    assert forest.height_limit(1024) == 10 and forest.height_limit(1000) == 10


def test_scores_rank_planted_outliers_first(trained):
    data, model, _ = trained
    rows = forest.raw_decision(data, model).orderBy(F.desc("forest_score")).collect()
    assert {r.vector_id for r in rows[:8]} == {f"v{i:05d}" for i in range(8)}
    assert all(0 < r.forest_score <= 1 for r in rows)
    share = sum(r.raw_score > 0 for r in rows) / len(rows)
    assert share == pytest.approx(0.05, abs=0.005)


def test_tree_shape(trained):
    _, _, nodes = trained
    rows = nodes.collect()
    assert {r.tree_id for r in rows} == set(range(40))
    by_id = {(r.tree_id, r.node_id): r for r in rows}
    for r in rows:
        assert r.depth <= 7 and r.node_id >= 2 ** r.depth and r.node_id < 2 ** (r.depth + 1)
        if r.feature >= 0:
            left, right = by_id[r.tree_id, 2 * r.node_id], by_id[r.tree_id, 2 * r.node_id + 1]
            assert left.size + right.size == r.size and left.size > 0 and right.size > 0
        else:
            assert (r.tree_id, 2 * r.node_id) not in by_id
            assert r.size == 1 or r.depth == 7


def test_same_seed_same_forest_whatever_the_partitions(spark, trained):
    data, _, nodes = trained
    again = forest.grow_forest(forest.tree_samples(data.repartition(5), 40, 128))
    order = ["tree_id", "node_id"]
    assert nodes.orderBy(order).collect() == again.orderBy(order).collect()


def test_samples_are_without_replacement(spark):
    data = cloud(spark, 300)
    rows = forest.tree_samples(data, 10, 64).groupBy("tree_id").agg(
        F.count("*").alias("n"), F.count_distinct("vector_id").alias("d")).collect()
    assert len(rows) == 10 and all(r.n == r.d == 64 for r in rows)
    few = forest.tree_samples(data.limit(20), 3, 64).groupBy("tree_id").count().collect()
    assert [r["count"] for r in few] == [20] * 3
    used = forest.tree_samples(data, 60, 64).select("vector_id").distinct().count()
    assert used > 290


def test_constant_columns_and_identical_rows(spark):
    same = cloud(spark, 50).withColumn("features", F.array(*[F.lit(1.0)] * 18))
    nodes = forest.grow_forest(forest.tree_samples(same, 2, 32)).collect()
    assert [(r.node_id, r.feature, r.size) for r in nodes] == [(1, -1, 32)] * 2


def test_fixed_forest_by_brute_force(spark):
    """A hand-written forest against a recursive walk over its nodes."""
    model = forest.load_forest(spark.createDataFrame(FIXED_FOREST, FOREST_NODE))
    table = {(t, n): (d, s, f, c) for t, n, d, s, f, c in FIXED_FOREST}

    def path(tree, x, node=1):
        depth, size, feature, cut = table[tree, node]
        if feature < 0:
            return depth + float(forest.average_path(size))
        return path(tree, x, 2 * node + int(x[feature] >= cut))

    data = cloud(spark, 100).withColumn("features", F.transform("features", lambda v: v * 3 + 3))
    expected = {r.vector_id: 2 ** (-np.mean([path(t, r.features) for t in range(3)]) / forest.average_path(8))
                for r in data.collect()}
    got = {r.vector_id: r.forest_score for r in forest.forest_scores(data, model).collect()}
    assert got == pytest.approx(expected)


def test_wrong_length_is_not_scored_and_nan_is_cleaned(spark, trained):
    _, model, _ = trained
    base = cloud(spark, 2, outliers=0)
    short = base.withColumn("features", F.slice("features", 1, 17))
    assert {r.forest_score for r in forest.forest_scores(short, model.forest).collect()} == {None}
    holed = base.withColumn("features", F.transform("features", lambda v, i: F.when(i == 0, float("nan")).otherwise(v)))
    zeroed = base.withColumn("features", F.transform("features", lambda v, i: F.when(i == 0, 0.0).otherwise(v)))
    a, b = ([r.forest_score for r in forest.forest_scores(d, model.forest).collect()] for d in (holed, zeroed))
    assert a == b


def test_too_few_rows_do_not_train(spark):
    assert forest.train(cloud(spark, 99), "v") is None


def test_results(spark, trained):
    data, model, _ = trained
    rows = results.score_vectors(
        data, model, "2026-01-02 00:00:00", baseline.image_baseline(data), baseline.global_baseline(data)).collect()
    hot = [r for r in rows if r.vector_id < "v00008"]
    assert all(r.is_anomalous and r.severity != "NONE" and len(r.contributing_features) == 5 for r in hot)
    assert all(r.description.startswith("Anomalous behavior detected (score: 0.") for r in hot)
    assert len({r.result_id for r in rows}) == len(rows)
    none = results.score_vectors(data, None, "2026-01-02 00:00:00").first()
    assert (none.anomaly_score, none.is_anomalous, none.severity, none.model_version) == (0.0, False, "LOW", "none")
    assert none.contributing_features == []


def test_metrics_are_counted_on_the_way(spark, trained, tmp_path):
    data, model, _ = trained
    scored = results.score_vectors(data, model, "2026-01-02 00:00:00")
    seen = Observation("scoring")
    results.observe_scoring(scored, seen).write.parquet(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert seen.get["vectors_scored"] == 400
    assert seen.get["anomalies"] == stored.filter("is_anomalous").count() > 0
    tiers = results.scoring_metrics(stored).agg(F.sum("scored"), F.sum("anomalies")).first()
    assert tuple(tiers) == (400, seen.get["anomalies"])


def test_retrain_stores_versions(spark, tmp_path):
    root = str(tmp_path)
    assert current_model(spark, root) is None
    assert retrain(cloud(spark, 50), root, datetime(2026, 1, 1)) is None
    first = retrain(cloud(spark), root, datetime(2026, 1, 1), trees=10, sample_size=64)
    second = retrain(cloud(spark, seed=2), root, datetime(2026, 1, 2), trees=10, sample_size=64)
    model = current_model(spark, root)
    assert model.version == second.version == "20260102000000" and first.version < second.version
    assert current_model(spark, root, model) is model
    assert model.offset == second.offset and (model.forest.threshold == second.forest.threshold).all()
    listed = registry.registry_listing(read_versions(spark, root, REGISTRY)).collect()
    assert [(r.version, r.is_current, r.registry_size) for r in listed] == [
        ("20260102000000", True, 2), ("20260101000000", False, 2)]
    assert listed[1].drift_score == 0.0 and listed[0].drift_score > 0.0
    assert registry.model_info(read_versions(spark, root, REGISTRY)).first().threshold_high == 0.75


def test_trees_draw_independently(spark):
    taken = {}
    for r in forest.tree_samples(cloud(spark), 12, 64).collect():
        taken.setdefault(r.tree_id, set()).add(r.vector_id)
    both = [(t, v) for t in range(10) for v in taken[t] & taken[t + 1]]
    # Of the rows that two neighbouring trees take, the next one takes about as few as of all.
    assert both and sum(v in taken[t + 2] for t, v in both) < 0.3 * len(both)


def test_a_model_of_kept_samples_is_that_of_all_vectors(spark, tmp_path):
    data, kept, whole = durable(cloud(spark, 900)), str(tmp_path / "kept"), str(tmp_path / "whole")
    for batch_id in range(5):
        for _ in range(2 if batch_id == 3 else 1):             # one batch is run again
            keep_samples(data.filter(F.crc32("vector_id") % 5 == batch_id), kept, batch_id, 10, 64)
    before = stored_samples(spark, kept, 10, 64, 2)
    assert before.count() == 640 and before.filter(F.crc32("vector_id") % 5 > 1).count() == 0
    one = retrain_on_samples(spark, kept, datetime(2026, 1, 1), 10, 64)
    other = retrain(data, whole, datetime(2026, 1, 1), trees=10, sample_size=64)
    nodes = [sorted(map(tuple, read_versions(spark, r, NODES).collect())) for r in (kept, whole)]
    assert nodes[0] == nodes[1] and one.samples == other.samples == 900
    for name in ("mean", "std"):
        a, b = (read_versions(spark, r, BASELINES).first()[name] for r in (kept, whole))
        assert a == pytest.approx(b)
    assert one.offset == pytest.approx(other.offset, abs=0.02)
    assert retrain_on_samples(spark, str(tmp_path / "none"), datetime(2026, 1, 1)) is None


def test_evaluation(spark):
    rng = np.random.default_rng(5)
    rows = [(bool(rng.random() < 0.3), round(float(rng.random()), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "is_attack boolean, anomaly_score double").withColumn(
        "is_anomalous", F.col("anomaly_score") > 0.5)
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert evaluation.area_under_roc(df).first().auc == pytest.approx(auc)
    m = evaluation.confusion_metrics(df).first()
    assert m.recall == pytest.approx(sum(p > 0.5 for p in pos) / len(pos))
    assert m.f1 == pytest.approx(2 * m.precision * m.recall / (m.precision + m.recall))
