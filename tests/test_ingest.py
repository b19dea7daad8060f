import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fingerspark.operators import ingest, results
from fingerspark.operators.keyed import first_per_key, insert_if_absent
from fingerspark.operators.paging import by_id
from fingerspark.sources import tables, topics
from fingerspark.sources.schemas import RUNTIME_EVENT
from fingerspark.sources.wire import decode_json, json_of, to_messages
from tests.support import START, runtime

NOW = "2026-03-20 13:00:00"


def messages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "offset int, value string")


def test_decode(spark):
    whole = json.dumps({"event_id": "e", "timestamp": "2026-03-20T12:00:01.050Z", "container_id": "c", "pid": 7,
                        "syscall": "read", "extra": {"x": 1}})
    rows = decode_json(messages(spark, whole, "{}", "not-json", '{"pid": "seven"}', ""), RUNTIME_EVENT)
    got = {r["offset"]: r for r in rows.collect()}
    assert got[0]["event_id"] == "e" and got[0]["pid"] == 7 and got[0]["decode_error"] is None
    assert got[0]["timestamp"] == datetime(2026, 3, 20, 12, 0, 1, 50000) and got[0]["port"] is None
    assert got[1]["decode_error"] is None and got[1]["event_id"] is None
    assert all(got[i]["decode_error"] == "malformed JSON" for i in (2, 3, 4))
    assert got[2]["raw"] == "not-json"


def test_encode_and_back(spark):
    events = runtime(spark, [{"event_id": "e", "timestamp": START + timedelta(microseconds=123456),
                              "container_id": None, "pid": 1, "syscall": "read"}])
    message = to_messages(events).first()
    assert message["key"] == "unknown"
    assert '"container_id":null' in message["value"] and "12:00:00.123456Z" in message["value"]
    again = decode_json(to_messages(events).select("value"), RUNTIME_EVENT)
    assert again.select(*RUNTIME_EVENT.names).collect() == events.collect()
    pretty = events.select(json_of("event_id", "pid", pretty=True)).first()[0]
    assert pretty == '{\n  "event_id" : "e",\n  "pid" : 1\n}'


def test_only_the_bad_rows_are_dead_lettered(spark):
    events = runtime(spark, [
        {"event_id": "1", "container_id": "c", "syscall": "PTRACE", "timestamp": START},
        {"event_id": "2", "container_id": " \t", "syscall": "read"},
        {"event_id": "3", "container_id": None, "syscall": "read"},
        {"event_id": "4", "container_id": "c", "syscall": None},
        {"event_id": "5", "container_id": "c", "syscall": "  "},
    ])
    assert [r.event_id for r in ingest.valid_events(events).collect()] == ["1"]
    letters = ingest.dead_letters(events, NOW).collect()
    assert sorted(r.reason for r in letters) == ["container_id is required"] * 2 + ["syscall is required"] * 2
    assert json.loads(letters[0].raw)["event_id"] == "2"
    row = ingest.process(events, NOW).first()
    assert (row.syscall, row.syscall_category, row.is_privileged) == ("ptrace", "SECURITY", True)


def test_defaults(spark):
    events = runtime(spark, [
        {"container_id": "c", "syscall": "read", "pid": 1}, {"container_id": "c", "syscall": "read", "pid": 2},
        {"event_id": "kept", "container_id": "c", "syscall": "read", "timestamp": START}])
    rows = ingest.with_defaults(events, NOW).collect()
    assert len({r.event_id for r in rows}) == 3 and "kept" in {r.event_id for r in rows}
    assert sorted(r.timestamp for r in rows)[-1] == datetime(2026, 3, 20, 13)
    again = ingest.with_defaults(events, NOW).collect()
    assert {r.event_id for r in rows} == {r.event_id for r in again}


def test_first_write_wins_and_duplicates_can_stay(spark):
    events = runtime(spark, [
        {"event_id": "a", "container_id": "c", "syscall": "read", "timestamp": START + timedelta(seconds=s),
         "process_name": f"p{s}"} for s in (3, 1, 2)])
    assert [r.process_name for r in ingest.process(events, NOW).collect()] == ["p1"]
    assert ingest.process(events, NOW, dedup=False).count() == 3


def test_copies_are_reduced_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    incoming = spark.createDataFrame([("b", 9), ("c", 5), ("c", 4), ("d", 1)], "k string, v int")
    added = insert_if_absent(target, incoming, "k", ["v"])
    assert sorted(map(tuple, added.collect())) == [("c", 4), ("d", 1)]


def test_append_and_retention(spark, tmp_path):
    path = str(tmp_path / "events")
    days = spark.createDataFrame([("a", "2026-03-12 11:00:00"), ("b", "2026-03-13 13:00:00"),
                                  ("c", "2026-03-20 01:00:00")], "k string, t string")
    days = days.withColumn("t", F.col("t").cast("timestamp"))
    tables.append_rows(days.limit(2), path, date_of="t")
    tables.append_rows(days.filter("k = 'c'"), path, date_of="t")
    stored = spark.read.parquet(path)
    assert stored.count() == 3 and "date" in stored.columns
    kept = tables.keep_recent(stored, "runtime_events", "t", NOW)
    assert sorted(r.k for r in kept.collect()) == ["b", "c"]


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.range(1).schema
    assert tables.read_batches(spark, path, schema).count() == 0
    for batch, rows in ((0, 3), (1, 5), (1, 4)):
        tables.write_batch(spark.range(rows), path, batch)
    assert tables.read_batches(spark, path, schema).count() == 7


def test_a_lookup_reads_only_where_its_key_may_be(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_clustered(rows, path, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("t/*.parquet"))
    assert len(files) > 1
    wanted = rows.agg(F.min("k").alias("k")).first()["k"]
    held = [f for f in files if wanted in spark.read.parquet(str(f)).agg(F.collect_list("k")).first()[0]]
    for file in files:                                         # the others' values become unreadable, not their footers
        if file not in held:
            data = bytearray(file.read_bytes())
            data[4:len(data) // 2] = bytes(len(data) // 2 - 4)
            file.write_bytes(data)
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert len(held) == 1 and by_id(spark.read.parquet(path), "k", wanted).count() == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).agg(F.max("k")).collect()


def test_flat_forms_are_read_back(spark):
    stored = spark.createDataFrame([("a,b", "LOW", True), (None, "LOW", False)], "contributing_features string, severity string, is_anomalous boolean")
    assert [r[0] for r in results.of_stored_form(stored).collect()] == [["a", "b"], []]


def test_shared_folder_is_the_named_one(spark):
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_event_files(spark, tmp_path):
    rows = [{"event_id": str(i), "timestamp": "2026-03-20T12:00:01.000Z", "syscall": "read", "more": i} for i in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    array = topics.read_event_files(spark, str(tmp_path / "array.json"), whole_documents=True)
    lines = topics.read_event_files(spark, str(tmp_path / "lines.json"))
    assert array.count() == 3 and array.orderBy("event_id").collect() == lines.orderBy("event_id").collect()
    assert array.first().timestamp == datetime(2026, 3, 20, 12, 0, 1)


def test_topic_options():
    read = topics.kafka_read_options("host:1", "runtime-events", topics.POLL_RECORDS["runtime-events"])
    assert read["startingOffsets"] == "earliest" and read["maxOffsetsPerTrigger"] == "500"
    assert topics.kafka_write_options("host:1", "t")["kafka.acks"] == "all"
    assert topics.dead_letter_topic("runtime-events") == "runtime-events.DLT"
