import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fingerspark.functions.fixed import FEATURE_NAMES
from fingerspark.operators import features, ingest
from tests.support import START, processed, repeat, runtime

NOW = "2026-03-20 13:00:00"


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_normal_window(spark):
    names = ["read", "write", "open", "close", "mmap"]
    row = only(features.window_features(processed(spark, [{"syscall": names[i % 5]} for i in range(100)])))
    assert row.total_events == 100 and len(row.features) == 18 and tuple(row.feature_names) == FEATURE_NAMES
    assert row.window_start == START and row.window_end == START + timedelta(seconds=30)
    assert row.syscall_frequencies == {n: 20 for n in names}


def test_frequencies(spark):
    rows = repeat(50, syscall="read") + repeat(30, syscall="write") + repeat(20, syscall="open")
    row = only(features.window_features(processed(spark, rows)))
    assert (row.syscall_read_freq, row.syscall_write_freq, row.syscall_open_freq) == (0.5, 0.3, 0.2)


def test_exact_names_and_null_syscalls(spark):
    rows = [{"syscall": s} for s in ("openat", "accept4", "execveat", None, "vfork")]
    row = only(features.window_features(processed(spark, rows)))
    assert row.total_events == 5 and row.unique_syscall_count == 4
    assert row.syscall_open_freq == row.syscall_accept_freq == row.syscall_exec_freq == 0.0
    assert row.process_creation_rate == 0.0
    assert row.syscall_entropy == pytest.approx(4 * -0.2 * -2.321928094887362)


def test_diversity(spark):
    rows = [dict(syscall="read", process_name=p) for p in ("nginx", "python3", "redis-server") for _ in range(30)]
    row = only(features.window_features(processed(spark, rows)))
    assert (row.unique_process_count, row.unique_syscall_count) == (3, 1)


def test_privileged_root_and_network(spark):
    rows = repeat(80, syscall="read") + repeat(20, syscall="ptrace", is_privileged=True, uid=0)
    row = only(features.window_features(processed(spark, rows)))
    assert (row.privileged_event_ratio, row.uid_zero_ratio) == (0.2, 0.2)
    rows = repeat(70, syscall="read", uid=None) + repeat(30, syscall="connect", is_network_event=True, port=80)
    row = only(features.window_features(processed(spark, rows)))
    assert (row.network_event_ratio, row.unique_dest_ports, row.uid_zero_ratio) == (0.3, 1, 0.0)


def test_entropy(spark):
    assert only(features.window_features(processed(spark, repeat(100, syscall="read")))).syscall_entropy == 0.0
    even = [dict(syscall=s) for s in ("read", "write", "open", "close") for _ in range(25)]
    assert only(features.window_features(processed(spark, even))).syscall_entropy == pytest.approx(2.0)


# The ten sample events: (container, syscall, process, destination, port, uid, offset ms).
SAMPLE = [
    ("abc123def456", "read", "nginx", None, None, 101, 1000),
    ("abc123def456", "write", "nginx", None, None, 101, 1050),
    ("789ghi012jkl", "connect", "redis-server", "10.0.1.50", 6379, 999, 2000),
    ("mno345pqr678", "openat", "python3", None, None, 1000, 2100),
    ("abc123def456", "ptrace", "sh", None, None, 0, 3000),
    ("abc123def456", "execve", "nc", None, None, 0, 3100),
    ("abc123def456", "connect", "nc", "10.99.99.1", 4444, 0, 3200),
    ("abc123def456", "mount", "bash", None, None, 0, 3300),
    ("mno345pqr678", "execve", "xmrig", None, None, 1000, 4000),
    ("stu901vwx234", "close", "postgres", None, None, 70, 5000),
]
GOLDEN = {
    "789ghi012jkl": (1, [0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0]),
    "abc123def456": (6, [.166667, .166667, 0, 0, .166667, .166667, 0, 0, 4, 6, .033333, 1, 1, .166667,
                         2.584963, 1.918296, .333333, .666667]),
    "mno345pqr678": (2, [0, 0, 0, 0, .5, 0, 0, 0, 2, 2, .033333, 0, 0, 0, 1, 1, 0, 0]),
    "stu901vwx234": (1, [0, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]),
}


def test_golden_trace(spark):
    names = ("container_id", "syscall", "process_name", "destination_ip", "port", "uid")
    rows = [{**dict(zip(names, s)), "event_id": f"e{i}", "timestamp": START + timedelta(milliseconds=s[6])}
            for i, s in enumerate(SAMPLE)]
    vectors = features.window_features(ingest.process(runtime(spark, rows), NOW))
    got = {r.container_id: (r.total_events, [round(x, 6) for x in r.features]) for r in vectors.collect()}
    assert got == GOLDEN


def test_windows_touch_but_do_not_overlap(spark):
    rows = [{"syscall": "read", "timestamp": START + timedelta(seconds=s)} for s in (29.999999, 30, 59.5)]
    got = features.window_features(processed(spark, rows)).orderBy("window_start").collect()
    assert [r.total_events for r in got] == [1, 2]
    assert len({r.vector_id for r in got}) == 2


def test_ids_do_not_depend_on_partitions(spark):
    events = processed(spark, [{"syscall": "read", "container_id": f"c{i % 7}"} for i in range(200)])
    one = {r.vector_id for r in features.window_features(events.coalesce(1)).collect()}
    many = {r.vector_id for r in features.window_features(events.repartition(8)).collect()}
    assert one == many and len(one) == 7


def test_cap_starts_a_new_vector(spark):
    events = processed(spark, repeat(25, syscall="read") + repeat(3, syscall="read", container_id="small"))
    got = features.capped_window_features(events, max_events=10).collect()
    assert sorted((r.container_id, r.chunk, r.total_events) for r in got) == [
        ("c1", 0, 10), ("c1", 1, 10), ("c1", 2, 5), ("small", 0, 3)]
    assert len({r.vector_id for r in got}) == 4


def test_cap_boundary(spark):
    """10,001 events with one and the same timestamp in one window."""
    events = processed(spark, repeat(10_001, syscall="read", timestamp=START))
    got = features.capped_window_features(events).collect()
    assert sorted(r.total_events for r in got) == [1, 10_000]


def test_multi_resolution_and_sliding(spark):
    rows = [{"syscall": "read", "timestamp": START + timedelta(seconds=s)} for s in (0, 40, 400)]
    got = features.multi_resolution_features(processed(spark, rows)).groupBy("window_duration_seconds").count()
    assert {r[0]: r[1] for r in got.collect()} == {30: 3, 300: 2, 900: 1}
    sliding = features.window_features(processed(spark, rows[:1]), 30, slide_seconds=10).collect()
    assert sorted(r.window_start for r in sliding) == [START - timedelta(seconds=s) for s in (20, 10, 0)]


def test_empty_windows(spark):
    rows = [{"syscall": "read", "timestamp": START + timedelta(seconds=s)} for s in (0, 95)]
    vectors = features.window_features(processed(spark, rows))
    got = features.fill_empty_windows(vectors).orderBy("window_start").collect()
    assert [r.total_events for r in got] == [1, 0, 0, 1]
    assert got[1].features == [0.0] * 18 and got[1].syscall_entropy is None
    assert got[1].window_duration_seconds == 0 and got[1].syscall_frequencies == {}


def test_rows(spark):
    vectors = features.window_features(processed(spark, repeat(4, syscall="read")))
    assert features.feature_rows(vectors).filter("feature = 'syscall_read_freq'").first().value == 1.0
    assert features.frequency_rows(vectors).first().n == 4


def test_features_need_no_wide_shuffle(spark):
    """Rows are combined before the first shuffle, and nothing is collected when not asked for."""
    events = processed(spark, repeat(4, syscall="read"))
    df = features.window_features(events).select("vector_id", "features")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_count(1)" in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_time_zone_less_input_keeps_its_flavour(spark):
    events = processed(spark, repeat(2, syscall="read")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert only(features.window_features(events)).window_start == datetime(2026, 3, 20, 12)


def test_stored_form(spark):
    vectors = features.window_features(processed(spark, [{"syscall": s} for s in ("read", "read", "open")]))
    row = features.stored_form(vectors).first()
    assert row.syscall_read_freq == 0.666667 and row.syscall_frequencies_json == '{"open":1,"read":2}'
    assert json.loads(row.features_json)[0] == pytest.approx(2 / 3) and len(json.loads(row.features_json)) == 18
