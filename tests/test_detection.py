import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fingerspark.operators import alerts, analytics, profiles
from fingerspark.sources.schemas import ANOMALY_RESULT, CONTAINER_PROFILE

NOW = datetime(2026, 3, 20, 12)


def results(spark, rows):
    """Results of (container, score, severity, hours ago)."""
    data = [(f"r{i:03d}", f"v{i:03d}", c, NOW - timedelta(hours=h), s, s > 0.5, level, "m", ["a"], "d", None, None)
            for i, (c, s, level, h) in enumerate(rows)]
    return spark.createDataFrame(data, ANOMALY_RESULT)


ROWS = [("a", 0.95, "CRITICAL", 1), ("a", 0.2, "NONE", 2), ("b", 0.8, "HIGH", 3), ("b", 0.55, "LOW", 3),
        ("c", 0.65, "MEDIUM", 24), ("d", 0.99, "CRITICAL", 25), (None, 0.1, "NONE", 1)]


@pytest.fixture(scope="module")
def found(spark):
    return results(spark, ROWS).cache()


def test_range_is_inclusive_and_stats_are_strict(found):
    assert analytics.find_anomalies(found, NOW).count() == 6
    stats = analytics.stats(found, NOW - timedelta(hours=24), NOW).first()
    assert (stats.total_scored, stats.total_anomalies, stats.critical_count, stats.high_count) == (5, 3, 1, 1)
    assert stats.affected_containers == 2
    nothing = analytics.stats(found, NOW, NOW).first()
    assert (nothing.total_scored, nothing.avg_anomaly_score) == (0, 0.0)


def test_filters(found):
    assert analytics.find_anomalies(found, NOW, severity="critical").count() == 1
    assert analytics.find_anomalies(found, NOW, severity=" ", container_id="").count() == 6
    assert analytics.find_anomalies(found, NOW, container_id="b").count() == 2
    page = analytics.anomaly_page(found, NOW, page=1, size=2).collect()
    assert [r.result_id for r in page] == ["r001", "r002"]


def test_trend_and_severity(found):
    trend = analytics.anomaly_trend(found, NOW, bucket_minutes=60).collect()
    assert [(r.bucket.hour, r.total, r.anomalies) for r in trend] == [(12, 1, 1), (9, 2, 2), (10, 1, 0), (11, 2, 1)]
    over = analytics.severity_over_time(found, NOW, bucket_minutes=60).collect()
    assert [(r.severity, r["count"]) for r in over] == [("MEDIUM", 1), ("HIGH", 1), ("LOW", 1), ("CRITICAL", 1)]


def test_top_containers(found):
    top = analytics.top_risky_containers(found, NOW, hours=48, limit=3).collect()
    assert [r.container_id for r in top] == ["b", "d", "a"]
    assert (top[0].worst_severity, top[0].max_severity_lex) == ("HIGH", "LOW")
    assert analytics.top_risky_containers(found, NOW, hours=24).count() == 2


def test_profiles(found):
    by = {r.container_id: r for r in profiles.container_profiles(found).collect()}
    assert set(by) == {"a", "b", "c", "d"}
    assert (by["a"].total_events, by["a"].total_anomalies, by["a"].anomaly_rate) == (2, 1, 0.5)
    assert by["a"].avg_anomaly_score == pytest.approx(0.575) and by["a"].risk_level == "CRITICAL"


def test_merging_batches_equals_one_pass(spark, found):
    state = spark.createDataFrame([], CONTAINER_PROFILE)
    for half in ("result_id >= 'r003'", "result_id < 'r003'"):
        state = profiles.merge_profiles(state, profiles.profile_delta(found.filter(half)))
    merged = {r.container_id: r for r in state.collect()}
    for row in profiles.container_profiles(found).collect():
        other = merged[row.container_id]
        assert other.avg_anomaly_score == pytest.approx(row.avg_anomaly_score)
        assert (other.total_events, other.first_seen, other.last_seen, other.risk_level) == (
            row.total_events, row.first_seen, row.last_seen, row.risk_level)


def test_merge_keeps_metadata_and_the_untouched(spark, found):
    old = profiles.container_profiles(found.filter("container_id = 'a'")).withColumn("image_name", F.lit("nginx"))
    merged = {r.container_id: r for r in profiles.merge_profiles(
        old, profiles.profile_delta(found.filter("container_id = 'b'"))).collect()}
    assert merged["a"] == old.first() and merged["b"].image_name is None


def test_trajectory(found):
    path = profiles.score_trajectory(found).filter("container_id = 'a'").orderBy("seen").collect()
    assert [r.running_avg for r in path] == pytest.approx([0.2, 0.575])


def test_behaviour(spark):
    events = spark.createDataFrame(
        [("c", "read", "nginx", None), ("c", "read", "sh", "10.0.0.1"), ("c", "write", None, "10.0.0.1")],
        "container_id string, syscall string, process_name string, destination_ip string")
    row = profiles.behaviour_columns(profiles.baseline_behaviour(events)).first()
    assert row.baseline_syscall_distribution == pytest.approx({"read": 2 / 3, "write": 1 / 3})
    assert (row.baseline_process_list, row.baseline_network_destinations) == (["nginx", "sh"], ["10.0.0.1"])


def test_alerts(found):
    raised = alerts.raise_alerts(found).orderBy("result_id").collect()
    assert [r.result_id for r in raised] == ["r000", "r002", "r005"]
    assert raised[0].title == "[CRITICAL] Anomaly detected on container a"
    assert raised[0].description == "score=0.9500 severity=CRITICAL resultId=r000"
    assert not any(r.acknowledged for r in raised)
    payload = json.loads(alerts.webhook_payloads(alerts.raise_alerts(found)).first().payload)
    assert set(payload) == {"alert_id", "container_id", "severity", "anomaly_score", "title", "triggered_at"}
    assert alerts.find_alerts(alerts.raise_alerts(found), "high", False).count() == 1


def test_first_acknowledgement_wins(spark, found):
    raised = alerts.raise_alerts(found)
    wanted = raised.filter("result_id = 'r000'").first().alert_id
    requests = spark.createDataFrame(
        [(wanted, "late", NOW), (wanted, "early", NOW - timedelta(hours=1)), ("unknown", "x", NOW)],
        "alert_id string, acknowledged_by string, acknowledged_at timestamp")
    once = alerts.acknowledge(raised, requests)
    row = once.filter("updated").first()
    assert (row.alert_id, row.acknowledged_by, row.acknowledged) == (wanted, "early", True)
    later = requests.withColumn("acknowledged_by", F.lit("again"))
    twice = alerts.acknowledge(once.drop("updated"), later)
    assert twice.filter("updated").count() == 0
    assert twice.filter("acknowledged").first().acknowledged_by == "early"


def test_lineage_keeps_alerts_without_vector(spark, found):
    vectors = spark.createDataFrame([("v000", 7, [1.0])], "vector_id string, total_events bigint, features array<double>")
    rows = {r.result_id: r for r in alerts.alert_lineage(alerts.raise_alerts(found), found, vectors).collect()}
    assert rows["r000"].total_events == 7 and rows["r002"].total_events is None
