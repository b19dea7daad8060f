"""Registered queries: sources, ingestion, collector columns."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.functions.containers import cgroup_container_id
from fingerspark.functions.syscalls import (
    dotted_address,
    protocol_name,
    syscall_category,
    syscall_dimension,
    syscall_name,
)
from fingerspark.operators import analytics, ingest
from fingerspark.plans import telemetry
from fingerspark.plans.check_sql import NOW, RUNTIME, category, syscall_name as sql_syscall_name
from fingerspark.plans.registered import query
from fingerspark.plans.telemetry import AS_OF, read
from fingerspark.sources.probes import container_of_process, runtime_events, with_environment
from fingerspark.sources.schemas import RUNTIME_EVENT
from fingerspark.sources.tables import drop_expired, keep_recent, read_batches, shared_folder, write_batch
from fingerspark.sources.wire import decode_json, json_of, to_messages

EVENT = "event_id, timestamp, container_id, syscall, process_name, uid, destination_ip, port, image_name"
SQL_EVENT = EVENT.replace("timestamp", '"timestamp"')
WALL = "timestamp_ntz"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime events as messages; those with k = 2 arrive as broken text."""
    projected = telemetry.project_runtime(read(spark, sf_dir, "events"))
    intact = json_of(*[c for c in RUNTIME_EVENT.names if c in projected.columns])
    return projected.select(
        F.col("seq").alias("offset"),
        F.when(F.col("k") == 2, F.concat(F.lit("not-json "), F.col("seq").cast("string")))
         .otherwise(intact).alias("value"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_json(_messages(spark, sf_dir), RUNTIME_EVENT)


@query(f"""WITH {RUNTIME}
SELECT seq AS "offset", CASE WHEN k = 2 THEN 'malformed JSON' END AS decode_error,
       {", ".join(f'CASE WHEN k <> 2 THEN {c} END AS {c}' for c in SQL_EVENT.split(", "))}
FROM runtime""")
def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = _decoded(spark, sf_dir)
    return decoded.withColumn("timestamp", F.col("timestamp").cast(WALL)).select(
        "offset", "decode_error", *EVENT.split(", "))


@query(f"""WITH {RUNTIME}
SELECT container_id AS "key",
       CAST(to_json({{'event_id': event_id, 'syscall': syscall, 'pid': pid, 'port': port,
                     'container_id': container_id}}) AS VARCHAR) AS value
FROM runtime""")
def encode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_messages(telemetry.runtime_events(spark, sf_dir).select(
        "event_id", "syscall", "pid", "port", "container_id"))


@query(f"""WITH {RUNTIME}
SELECT seq AS "offset",
       CASE WHEN k = 2 THEN 'malformed JSON'
            WHEN trim(container_id) = '' THEN 'container_id is required'
            ELSE 'syscall is required' END AS reason,
       CASE WHEN k = 2 THEN concat('not-json ', seq) END AS broken_text,
       {NOW} AS received_at
FROM runtime
WHERE k = 2 OR trim(container_id) = '' OR syscall IS NULL""")
def dead_letter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = ingest.dead_letters(_decoded(spark, sf_dir), AS_OF)
    broken = F.when(F.col("reason") == "malformed JSON", F.col("raw"))
    return letters.select("offset", "reason", broken.alias("broken_text"), "received_at")


@query(f"""WITH {RUNTIME} SELECT {SQL_EVENT} FROM valid WHERE k <> 2""")
def valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = ingest.valid_events(_decoded(spark, sf_dir))
    return valid.withColumn("timestamp", F.col("timestamp").cast(WALL)).select(*EVENT.split(", "))


@query(f"""WITH {RUNTIME}
SELECT {SQL_EVENT}, syscall_category, is_privileged, is_network_event, {NOW} AS received_at
FROM processed""")
def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = ingest.valid_events(telemetry.runtime_events(spark, sf_dir))
    return ingest.enrich(usable, AS_OF).select(
        *EVENT.split(", "), "syscall_category", "is_privileged", "is_network_event", "received_at")


@query(f"""WITH {RUNTIME}
SELECT CASE WHEN k % 7 = 3 THEN md5(concat_ws('|', strftime("timestamp", '%Y%m%d%H%M%S'), container_id,
            coalesce(syscall, ''), CAST(pid AS VARCHAR), CAST(return_value AS VARCHAR)))
            ELSE event_id END AS event_id,
       CASE WHEN k % 11 = 4 THEN {NOW} ELSE "timestamp" END AS "timestamp"
FROM runtime""")
def defaulted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = telemetry.project_runtime(read(spark, sf_dir, "events"))
    holed = projected.withColumns({
        "stamp": F.date_format("timestamp", "yyyyMMddHHmmss"),
        "event_id": F.when(F.col("k") % 7 != 3, F.col("event_id")),
        "timestamp": F.when(F.col("k") % 11 != 4, F.col("timestamp")),
    })
    identity = ("stamp", "container_id", "syscall", "pid", "return_value")
    return ingest.with_defaults(holed, AS_OF, identity).select("event_id", "timestamp")


@query(f"""WITH {RUNTIME}
SELECT {category('syscall')} AS syscall_category, count(*) AS n FROM runtime GROUP BY 1""")
def syscall_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = telemetry.runtime_events(spark, sf_dir)
    return events.groupBy(syscall_category("syscall").alias("syscall_category")).agg(
        F.count("*").alias("n"))


_FIRST_COPY = f"""WITH {RUNTIME},
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") AS nth FROM copies)
SELECT event_id, "timestamp", container_id, {{syscall}} AS syscall, process_name FROM ranked
WHERE nth = 1 {{also}}"""


@query(_FIRST_COPY.format(syscall="syscall", also=""))
def dedup_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_write(telemetry.with_copies(spark, sf_dir)).select(
        "event_id", "timestamp", "container_id", "syscall", "process_name")


@query(_FIRST_COPY.format(
    syscall="lower(syscall)", also="AND trim(container_id) <> '' AND syscall IS NOT NULL"))
def dedup_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.process(telemetry.with_copies(spark, sf_dir), AS_OF).select(
        "event_id", "timestamp", "container_id", "syscall", "process_name")


_HALF = "2024-01-16 00:00:00"


@query(f"""WITH {RUNTIME},
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") AS nth
           FROM copies WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00')
SELECT event_id, "timestamp", process_name FROM ranked
WHERE nth = 1 AND event_id NOT IN (SELECT event_id FROM runtime WHERE "timestamp" < TIMESTAMP '{_HALF}')""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telemetry.runtime_events(spark, sf_dir).filter(F.col("timestamp") < F.lit(_HALF).cast(WALL))
    copies = telemetry.with_copies(spark, sf_dir)
    incoming = copies.filter(F.col("timestamp") >= F.lit("2024-01-10 00:00:00").cast(WALL))
    return ingest.new_events(stored, incoming).select("event_id", "timestamp", "process_name")


@query(f"""SELECT event_id, {sql_syscall_name('CAST(event_id % 440 AS INT)')} AS syscall FROM events""")
def syscall_id_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", syscall_name("event_id % 440").alias("syscall"))


@query(f"""SELECT {sql_syscall_name('CAST(event_id % 440 AS INT)')} AS syscall, count(*) AS n
FROM events GROUP BY 1""")
def syscall_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = read(spark, sf_dir, "events").select((F.col("event_id") % 440).cast("int").alias("syscall_id"))
    # The dimension has a fixed 68 rows.
    named = numbered.join(F.broadcast(syscall_dimension(spark)), "syscall_id", "left")
    name = F.coalesce("syscall", F.concat(F.lit("unknown_"), F.col("syscall_id").cast("string")))
    return named.groupBy(name.alias("syscall")).agg(F.count("*").alias("n"))


@query("""SELECT event_id,
  concat(a & 255, '.', (a >> 8) & 255, '.', (a >> 16) & 255, '.', (a >> 24) & 255) AS ip
FROM (SELECT event_id, event_id * 7919 % 4294967296 AS a FROM events)""")
def int_to_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.col("event_id") * 7919 % F.lit(4294967296)
    return read(spark, sf_dir, "events").select("event_id", dotted_address(packed).alias("ip"))


@query("""SELECT CASE c WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(c AS VARCHAR) END AS protocol, count(*) AS n
FROM (SELECT CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS c FROM events) GROUP BY 1""")
def protocol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 3 == 0, 6).when(F.col("event_id") % 3 == 1, 17).otherwise(1)
    return read(spark, sf_dir, "events").groupBy(protocol_name(code).alias("protocol")).agg(
        F.count("*").alias("n"))


@query("""SELECT event_id AS line_no,
  CASE WHEN event_id % 6 <> 5 THEN substr(md5(CAST(user_id AS VARCHAR)), 1, 12) END AS container_id
FROM events""")
def cgroup_container_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.cgroup_lines(spark, sf_dir).select(
        "line_no", cgroup_container_id(F.col("line")).alias("container_id"))


@query("""SELECT concat('node-', user_id % 3) AS hostname, user_id AS pid,
  max(CASE WHEN event_id % 6 <> 5 THEN substr(md5(CAST(user_id AS VARCHAR)), 1, 12) END) AS container_id
FROM events GROUP BY user_id""")
def cgroup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_of_process(telemetry.cgroup_lines(spark, sf_dir))


@query("""SELECT event_id AS pid, CASE WHEN event_id % 3 <> 0 THEN concat('c', user_id) END AS container_id,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN concat('app=', user_id)
       WHEN event_id % 4 = 1 THEN concat('img', user_id) END AS image_name,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'last'
       WHEN event_id % 5 = 1 THEN concat('k8s', user_id) ELSE 'pod' END AS namespace
FROM events""")
def env_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_environment(telemetry.process_environments(spark, sf_dir))


_ADDRESS = "concat({a} & 255, '.', ({a} >> 8) & 255, '.', ({a} >> 16) & 255, '.', ({a} >> 24) & 255)"
_PROBES = f"""SELECT concat('p-', event_id) AS event_id, ts AS "timestamp",
  CASE WHEN event_id % 7 <> 0 THEN concat('c', user_id % 5) ELSE 'host' END AS container_id,
  CASE WHEN event_type = 'purchase' THEN 'connect'
       ELSE {sql_syscall_name('CAST(event_id % 440 AS INT)')} END AS syscall,
  CASE WHEN event_type = 'purchase' THEN {_ADDRESS.format(a='(event_id * 7919 % 4294967296)')} END AS destination_ip,
  CASE WHEN event_type = 'purchase' THEN {_ADDRESS.format(a='(event_id * 104729 % 4294967296)')} END AS source_ip,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 65536 AS INT) END AS port,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE '1' END END AS protocol,
  CASE WHEN event_type <> 'purchase' THEN CAST(1 AS BIGINT) END AS ppid, user_id AS uid
FROM events"""
_PROBE_COLUMNS = ("event_id", "timestamp", "container_id", "syscall", "destination_ip", "source_ip", "port",
                  "protocol", "ppid", "uid")


@query(_PROBES)
def probe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime_events(
        telemetry.syscall_probes(spark, sf_dir), telemetry.network_probes(spark, sf_dir),
        containers_only=False).select(*_PROBE_COLUMNS)


@query(_PROBES + " WHERE event_id % 7 <> 0")
def probe_union_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime_events(
        telemetry.syscall_probes(spark, sf_dir), telemetry.network_probes(spark, sf_dir),
    ).select(*_PROBE_COLUMNS)


@query("SELECT count(*) AS n FROM events")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_events(telemetry.runtime_events(spark, sf_dir))


@query(f"WITH {RUNTIME} SELECT count(*) AS n FROM runtime WHERE container_id = 'c3'")
def event_count_of_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_events(telemetry.runtime_events(spark, sf_dir), "c3")


@query(f"WITH {RUNTIME} SELECT container_id, count(*) AS n FROM runtime GROUP BY 1")
def event_counts_by_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_events_by_container(telemetry.runtime_events(spark, sf_dir))


@query(f"""WITH {RUNTIME}
SELECT event_id, "timestamp" FROM runtime WHERE "timestamp" >= {NOW} - INTERVAL 7 DAY""")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = telemetry.runtime_events(spark, sf_dir)
    return keep_recent(events, "runtime_events", "timestamp", AS_OF).select("event_id", "timestamp")


@query(f"""WITH {RUNTIME}
SELECT event_id, "timestamp" FROM processed
WHERE CAST("timestamp" AS DATE) >= CAST({NOW} - INTERVAL 7 DAY AS DATE)""")
def retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored event table after its expired dates have been removed."""
    path = f"{shared_folder(spark)}/retention-{uuid4().hex}/processed_events"
    events = telemetry.stored_events(spark, sf_dir).withColumn("date", F.to_date("timestamp"))
    for batch_id, part in enumerate((F.col("pid") % 2 == 0, F.col("pid") % 2 != 0)):
        write_batch(events.filter(part), path, batch_id, "date")
    drop_expired(spark, path, "processed_events", telemetry.AS_OF_TIME)
    return read_batches(spark, path, events.schema).select("event_id", "timestamp")
