import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.operators import baseline, features, ingest, profiles
from fingerspark.plans import stream_queries
from fingerspark.plans.retrain import retrain
from fingerspark.sources.schemas import (
    ALERT,
    ANOMALY_RESULT,
    FEATURE_VECTOR,
    PROCESSED_EVENT,
    RUNTIME_EVENT,
)
from fingerspark.sources import states
from fingerspark.sources.tables import drop_expired, read_batches, write_batch
from fingerspark.sources.topics import read_file_stream
from fingerspark.streaming import jobs, windows
from tests.support import START, runtime
from tests.test_forest import cloud

COLUMNS = ["container_id", "window_start", "total_events", "features", "syscall_frequencies"]


def slices(spark, path, *batches):
    """Write each batch as one file, in order, and stream them one at a time."""
    for i, rows in enumerate(batches):
        runtime(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return read_file_stream(spark, path, RUNTIME_EVENT, max_files=1)


def event(i, seconds, **more):
    return {"event_id": f"e{i}", "timestamp": START + timedelta(seconds=seconds), "container_id": f"c{i % 2}",
            "syscall": ("read", "connect", "execve")[i % 3], "process_name": f"p{i % 4}", "uid": i % 2, "port": i % 5,
            "image_name": "img", **more}


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def key(rows):
    return sorted((r.container_id, r.window_start, r.total_events, tuple(round(x, 9) for x in r.features),
                   tuple(sorted(r.syscall_frequencies.items()))) for r in rows)


def test_stream_equals_batch_with_duplicates_and_disorder(spark, tmp_path):
    first = [event(i, i) for i in range(40)]
    # Out of order but their window is still open; copies of earlier events in it.
    second = [event(100, 31), event(39, 39), event(38, 38)] + [event(i, i) for i in range(41, 80)]
    third = [event(i, i) for i in range(80, 95)] + [event(200, 1, container_id=" ")]
    end = [event(999, 10_000)]
    stream = slices(spark, str(tmp_path / "in"), first, second, third, end)
    vectors = jobs.feature_stream(jobs.processed_stream(stream))
    run(jobs.start_table_sink(vectors, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True))
    got = spark.read.schema(FEATURE_VECTOR).parquet(str(tmp_path / "out"))
    events = ingest.process(runtime(spark, first + second + third), "2026-03-20 13:00:00")
    assert key(got.collect()) == key(features.window_features(events).select(*COLUMNS).collect())


HORIZON = 24 * 3600


def vectors_of(spark, tmp_path, batches, **options):
    """Generations of the windows that the batches make, by container, start and number."""
    stream = jobs.new_event_stream(slices(spark, str(tmp_path / "in"), *batches), HORIZON)
    vectors = windows.window_stream(ingest.enrich(stream, "2026-03-20 13:00:00"), horizon_seconds=HORIZON, **options)
    run(jobs.start_table_sink(vectors, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True))
    schema = T.StructType([*FEATURE_VECTOR.fields, T.StructField("generation", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    assert len({r.vector_id for r in rows}) == len(rows)
    return {(r.container_id, int((r.window_start - START).total_seconds()), r.generation): r for r in rows}


def test_late_events_give_supplementary_vectors(spark, tmp_path):
    batches = [[event(i, i) for i in range(30)], [event(50, 75)], [event(60, 5), event(61, 61), event(62, 76)],
               [event(64, 6), event(66, 7), event(60, 5)], [event(998, 5_000)]]
    got = vectors_of(spark, tmp_path, batches)
    # The second and third vector of the first window are those of the batches with late events.
    assert {k: r.total_events for k, r in got.items()} == {
        ("c0", 0, 0): 15, ("c1", 0, 0): 15, ("c0", 60, 0): 2, ("c1", 60, 0): 1, ("c0", 0, 1): 1, ("c0", 0, 2): 2}
    table = features.window_features(ingest.process(runtime(spark, batches[0]), "2026-03-20 13:00:00")).collect()
    assert {r.vector_id for r in table} == {got["c0", 0, 0].vector_id, got["c1", 0, 0].vector_id}
    assert got["c0", 0, 1].features[0] == 1.0 and got["c0", 0, 1].syscall_frequencies == {"read": 1}


def test_a_window_that_is_full_starts_anew(spark, tmp_path):
    rows = [event(2 * i, i / 10) for i in range(50)]
    got = vectors_of(spark, tmp_path, [rows[:7], rows[7:8], rows[8:], [event(999, 900)]], max_events=8)
    assert [got["c0", 0, g].total_events for g in range(7)] == [8, 8, 8, 8, 8, 8, 2]
    chunks = features.capped_window_features(ingest.process(runtime(spark, rows), "2026-03-20 13:00:00"), max_events=8)
    for row in chunks.collect():
        same = got["c0", 0, row.chunk]
        assert key([row]) == key([same]) and row.image_name == same.image_name


def test_a_window_stream_without_a_cap_gives_one_vector_a_window(spark, tmp_path):
    many = 10_100
    rows = spark.range(many).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:01' + make_dt_interval(0, 0, 0, id / 10) AS ts", "7L AS user_id",
        "'view' AS event_type", "1.0D AS value", """'{"k": 42}' AS props""")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = stream_queries.stream_window_features(spark, str(tmp_path)).collect()
    assert [(r.container_id, r.total_events) for r in got if r.container_id == "c2"] == [("c2", many)]


def test_a_capped_window_goes_by_time_across_the_pieces_of_a_batch(spark, tmp_path):
    rows = [event(2 * i, (7 * i % 50) / 10) for i in range(50)]
    pieces = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = vectors_of(spark, tmp_path, [rows, [event(999, 900)]], max_events=8)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", pieces)
    chunks = features.capped_window_features(ingest.process(runtime(spark, rows), "2026-03-20 13:00:00"), max_events=8).collect()
    assert len(chunks) == 7
    for row in chunks:
        assert key([row]) == key([got["c0", 0, row.chunk]])


def test_equal_events_without_id_all_count(spark, tmp_path):
    rows = [event(0, 3, event_id=None)] * 3 + [event(0, 4, event_id="x")] * 2
    got = vectors_of(spark, tmp_path, [rows, [event(0, 5, event_id="x"), event(0, 6, event_id=None)], [event(999, 900)]])
    assert got["c0", 0, 0].total_events == 5
    stream = slices(spark, str(tmp_path / "in2"), rows, [event(999, 900)])
    table = jobs.feature_stream(jobs.processed_stream(stream))
    run(jobs.start_table_sink(table, str(tmp_path / "out2"), str(tmp_path / "cp2"), available_now=True))
    assert [r.total_events for r in spark.read.schema(FEATURE_VECTOR).parquet(str(tmp_path / "out2")).collect()] == [4]


def test_copies_across_a_window_edge_count_once(spark, tmp_path):
    got = vectors_of(spark, tmp_path, [[event(0, 29)], [event(0, 30), event(2, 31)], [event(999, 900)]])
    assert {k: r.total_events for k, r in got.items()} == {("c0", 0, 0): 1, ("c0", 30, 0): 1}


def test_a_batch_of_events_that_failed_is_stored_once(spark, tmp_path):
    root, failed = str(tmp_path / "tables"), []
    sink = jobs.event_sink(root)

    def failing(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("written but not committed")

    batches = [[event(i, i) for i in range(5)], [event(1, 1), event(7, 100_000)], [event(7, 7), event(8, 8)]]
    stream = jobs.new_event_stream(slices(spark, str(tmp_path / "in"), *batches))
    with pytest.raises(StreamingQueryException):
        jobs.start_batches(stream, failing, str(tmp_path / "cp"), available_now=True).awaitTermination()
    run(jobs.start_batches(stream, failing, str(tmp_path / "cp"), available_now=True))
    for table, schema in (("runtime_events", RUNTIME_EVENT), ("processed_events", PROCESSED_EVENT)):
        rows = read_batches(spark, f"{root}/{table}", schema).collect()
        assert sorted(r.event_id for r in rows) == ["e0", "e1", "e2", "e3", "e4", "e7", "e8"]
        assert {r.event_id for r in rows if r.date > START.date()} == {"e7"}


def test_messages_are_decoded_and_split(spark, tmp_path):
    path = str(tmp_path / "in")
    texts = [json.dumps({"event_id": "1", "container_id": "c", "syscall": "READ", "timestamp": "2026-03-20T12:00:01Z"}),
             "not-json", json.dumps({"event_id": "2", "syscall": "read"})]
    spark.createDataFrame([(None, t) for t in texts], "key string, value string").coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    for name, job in (("dead", lambda e: jobs.dead_letter_stream(e)),
                      ("good", lambda e: jobs.processed_stream(e).drop("window"))):
        events = jobs.decoded_events(read_file_stream(spark, path, schema))
        run(jobs.start_table_sink(job(events), str(tmp_path / name), str(tmp_path / f"{name}-cp"), available_now=True))
    dead = {r.reason for r in spark.read.parquet(str(tmp_path / "dead")).collect()}
    assert dead == {"malformed JSON", "container_id is required"}
    good = spark.read.parquet(str(tmp_path / "good")).collect()
    assert [(r.event_id, r.syscall) for r in good] == [("1", "read")]


def test_detection_before_and_after_a_model(spark, tmp_path):
    root, incoming = str(tmp_path / "tables"), str(tmp_path / "in")
    data = cloud(spark)
    data.limit(100).coalesce(1).write.parquet(incoming)
    sink = jobs.detection_sink(root, F.col("window_end"))
    stream = read_file_stream(spark, incoming, data.schema, max_files=1)
    run(jobs.start_batches(stream, sink, str(tmp_path / "cp"), available_now=True))
    before = read_batches(spark, f"{root}/anomaly_results", ANOMALY_RESULT)
    assert {r.model_version for r in before.select("model_version").distinct().collect()} == {"none"}

    retrain(data, root, datetime(2026, 1, 2), trees=20, sample_size=64)
    data.coalesce(1).write.mode("append").parquet(incoming)
    run(jobs.start_batches(read_file_stream(spark, incoming, data.schema, max_files=1), sink,
                           str(tmp_path / "cp"), available_now=True))
    results = read_batches(spark, f"{root}/anomaly_results", ANOMALY_RESULT)
    assert results.filter("model_version = '20260102000000'").count() == 400
    state = jobs.stored_profiles(spark, root)
    assert state.agg(F.sum("total_events")).first()[0] == 500
    raised = read_batches(spark, f"{root}/alert_history", ALERT).count()
    assert raised == results.filter("is_anomalous AND severity IN ('HIGH', 'CRITICAL')").count()


def test_a_replayed_batch_counts_once(spark, tmp_path):
    root = str(tmp_path)
    at = datetime(2026, 1, 1)
    rows = [(f"r{i}", f"v{i}", "c", at, 0.8, True, "HIGH", "m", ["a"], "d", None, None) for i in range(5)]
    batch = spark.createDataFrame(rows, ANOMALY_RESULT)
    for batch_id in (0, 1, 1, 2):
        jobs.maintain(batch, root, batch_id)
    state = jobs.stored_profiles(spark, root, 3).first()
    assert state.total_events == 15 and state.avg_anomaly_score == 0.8
    assert read_batches(spark, f"{root}/alert_history", ALERT).count() == 15
    assert read_batches(spark, f"{root}/webhook_outbox", ALERT).count() == 15
    assert profiles.find_containers(jobs.stored_profiles(spark, root), "critical").count() == 1
    assert jobs.stored_profiles(spark, root, 1).first().total_events == 5


def test_many_batches_leave_few_folders(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = jobs.PROFILE_DELTA

    def row(container, n, at):
        return (container, n, 1, n / 2, n / 10, datetime(2026, 1, at), datetime(2026, 1, at))

    def folders():
        return {kind: states.complete_batches(spark, f"{path}/{kind}") for kind in (states.BASE, states.ADDED)}

    for batch_id in range(50):
        for _ in range(2 if batch_id % 7 == 0 else 1):         # some are run again
            rows = [row("a", 1, 1 + batch_id % 28), row(f"c{batch_id}", 2, 3)]
            states.add(spark.createDataFrame(rows, schema).coalesce(1), path, batch_id, profiles.fold_deltas, most=4)
        held = folders()
        assert len(held[states.BASE]) <= 2 and len(held[states.ADDED]) <= 9
    before = added_profiles(spark, path, 47)
    assert before["a"].total_events == 47 and len(before) == 48 and "c47" not in before
    assert added_profiles(spark, path, 99)["a"].total_anomalies == 50
    # A base whose writing was cut short does not count.
    (tmp_path / "state" / "base" / "batch_id=49").mkdir()
    assert added_profiles(spark, path, 99)["a"].total_events == 50


def added_profiles(spark, path, before):
    folded = profiles.fold_deltas(states.added_before(spark, path, before, jobs.PROFILE_DELTA))
    return {r.container_id: r for r in profiles.profiles_of(folded).collect()}


def test_folded_moments_are_those_of_all_vectors(spark):
    data = cloud(spark).withColumn("image_name", F.lit("img"))
    parts = [baseline.image_moments(data.filter(F.crc32("vector_id") % 4 == i)) for i in range(4)]
    folded = baseline.fold_moments(parts[0].union(parts[1]).union(parts[2]).union(parts[3])).first()
    whole = baseline.image_moments(data).first()
    assert folded.n == whole.n
    for got, want in ((folded.mean, whole.mean), (folded.m2, whole.m2)):
        assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(got, want))


def test_dates_leave_with_their_retention(spark, tmp_path):
    path = str(tmp_path / "processed_events")
    for batch_id, days in enumerate(([1, 2], [2, 9], [10])):
        rows = [event(d, d * 86_400) for d in days]
        write_batch(runtime(spark, rows).withColumn("date", F.to_date("timestamp")), path, batch_id, "date")
    as_of = START + timedelta(days=10)
    assert drop_expired(spark, path, "processed_events", as_of) == ["2026-03-21", "2026-03-22"]
    assert {r.event_id for r in read_batches(spark, path, RUNTIME_EVENT).collect()} == {"e9", "e10"}
    assert drop_expired(spark, path, "processed_events", as_of) == []
