"""Telemetry projected from the given tables.

The given data has no kernel telemetry; its ``events`` table is projected to runtime
events, results and probe records, row by row, so everything grows with that table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.functions.fixed import FEATURE_NAMES
from fingerspark.functions.scoring import is_anomalous, severity
from fingerspark.operators.features import window_features
from fingerspark.operators.ingest import process
from fingerspark.sources.schemas import ANOMALY_RESULT, RUNTIME_EVENT, conform
from fingerspark.sources.tables import durable

AS_OF_TIME = datetime(2024, 1, 31)
AS_OF = AS_OF_TIME.isoformat(sep=" ")
WINDOW = 6 * 3600

# Names of normal and of suspicious activity.
NORMAL_SYSCALLS = ("read", "write", "open", "close", "stat", "mmap", "brk", "openat")
SUSPICIOUS_SYSCALLS = ("ptrace", "mount", "execve", "clone", "bpf", "seccomp")
NORMAL_PROCESSES = ("nginx", "redis-server", "python3", "postgres", "node")
SUSPICIOUS_PROCESSES = ("nc", "nmap", "curl", "sh", "bash")
PORTS = (80, 443, 8080, 3306, 5432, 6379, 9092, 22, 4444, 8888)


# The given events table. Naming its schema saves a look into the file per query.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.read.schema(EVENTS) if table == "events" else spark.read
    return reader.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: tuple, index: str) -> str:
    listed = ", ".join(repr(v) for v in values)
    return f"element_at(array({listed}), CAST(({index}) % {len(values)} + 1 AS INT))"


def project_runtime(activity: DataFrame) -> DataFrame:
    """Behaviour events (event_id, ts, user_id, event_type, props) as runtime events.

    ``k`` (0 to 99) and ``seq`` (the source's event number) are kept next to the schema.
    """
    based = activity.selectExpr(
        "event_id AS seq", "ts", "user_id", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        "event_type = 'error' AS failed", "event_type = 'purchase' AS bought")
    normal = _pick(NORMAL_SYSCALLS, "seq + k")
    return based.selectExpr(
        "seq", "k",
        "concat('evt-', seq) AS event_id",
        "ts AS timestamp",
        "CASE WHEN k = 0 THEN ' ' ELSE concat('c', user_id % 5) END AS container_id",
        "user_id + 1000 AS pid",
        "1L AS ppid",
        f"""CASE WHEN k = 1 THEN NULL
                 WHEN failed THEN {_pick(SUSPICIOUS_SYSCALLS, 'seq + k')}
                 WHEN bought THEN 'connect'
                 WHEN k % 10 = 3 THEN upper({normal})
                 ELSE {normal} END AS syscall""",
        f"""CASE WHEN failed THEN {_pick(SUSPICIOUS_PROCESSES, 'seq + k')}
                 ELSE {_pick(NORMAL_PROCESSES, 'user_id')} END AS process_name""",
        "CAST(k AS BIGINT) AS return_value",
        "CASE WHEN bought THEN concat('10.0.', user_id % 4, '.', k) END AS destination_ip",
        f"CASE WHEN bought THEN {_pick(PORTS, 'k')} END AS port",
        "CASE WHEN bought THEN 'TCP' END AS protocol",
        "CASE WHEN failed AND k % 2 = 0 THEN 0L ELSE user_id + 1000 END AS uid",
        "concat('node-', user_id % 3) AS hostname",
        "concat('img', user_id % 5) AS image_name",
        "concat('ns', user_id % 2) AS namespace",
    )


def runtime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(project_runtime(read(spark, sf_dir, "events")), RUNTIME_EVENT)


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime events where those with k = 5 arrive again a second later, changed."""
    projected = project_runtime(read(spark, sf_dir, "events"))
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    again = projected.filter("k = 5").withColumns({
        "timestamp": F.col("timestamp") + second, "process_name": F.lit("copy")})
    return conform(projected.unionByName(again), RUNTIME_EVENT)


def processed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(runtime_events(spark, sf_dir), AS_OF)


def feature_vectors(spark: SparkSession, sf_dir: str, seconds: int = WINDOW) -> DataFrame:
    return window_features(processed_events(spark, sf_dir), seconds)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed events as a stored table, for work that reads them several times."""
    return durable(processed_events(spark, sf_dir))


def stored_vectors(spark: SparkSession, sf_dir: str, seconds: int = WINDOW) -> DataFrame:
    """The feature vectors as a stored table, for work that reads them several times."""
    return durable(feature_vectors(spark, sf_dir, seconds))


def anomaly_results(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Results with score k/100, which visits every tier and its edges; ``keep`` names
    columns of the event that are kept besides."""
    based = read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", *keep, "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100D AS anomaly_score")
    score = F.col("anomaly_score")
    scored = based.select(
        F.expr("concat('r-', event_id) AS result_id"),
        F.expr("concat('v-', event_id) AS vector_id"),
        F.expr("concat('c', user_id % 40) AS container_id"),
        F.col("ts").alias("detected_at"),
        score,
        is_anomalous(score).alias("is_anomalous"),
        severity(score).alias("severity"),
        F.lit("20240101000000").alias("model_version"),
        F.expr(f"array({_pick(FEATURE_NAMES, 'k')}, {_pick(FEATURE_NAMES, 'k + 5')}) AS contributing_features"),
        *keep,
    )
    result = conform(scored, ANOMALY_RESULT)
    return result if not keep else scored.select(*[
        F.col(c) if c in scored.columns else F.lit(None).alias(c) for c in result.columns], *keep)


def cgroup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cgroup line per event in six shapes, the id hashed from the user."""
    user = F.col("user_id").cast("string")
    full = F.concat(F.md5(user), F.md5(F.concat(F.lit("x"), user)))
    shapes = [
        F.concat(F.lit("12:memory:/docker/"), full),
        F.concat(F.lit("0::/system.slice/docker-"), full, F.lit(".scope")),
        F.concat(F.lit("0::/kubepods.slice/cri-containerd-"), full, F.lit(".scope\n")),
        F.concat(F.lit("0::/machine.slice/libpod-"), full, F.lit(".scope/container")),
        F.concat(F.lit("1:name=systemd:/sandbox/pod-"), full, F.lit("-shim/"), F.substring(full, 1, 20)),
        F.lit("0::/user.slice/user-1000.slice"),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("hostname"),
        F.col("user_id").alias("pid"),
        shape.alias("line"),
    )


def process_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One process environment per event; every third is outside any container."""
    user, n = F.col("user_id").cast("string"), F.col("event_id")
    image = F.when(n % 4 == 0, F.concat(F.lit("IMAGE_NAME=app="), user)).when(
        n % 4 == 1, F.concat(F.lit("IMAGE_NAME=\0CONTAINER_IMAGE=img"), user)).otherwise(F.lit("TERM=xterm"))
    space = F.when(n % 5 == 0, F.lit("NAMESPACE=first\0NAMESPACE=last")).when(
        n % 5 == 1, F.concat(F.lit("K8S_NAMESPACE=k8s"), user)).otherwise(F.lit("POD_NAMESPACE=pod"))
    return read(spark, sf_dir, "events").select(
        n.alias("pid"),
        F.when(n % 3 != 0, F.concat(F.lit("c"), user)).alias("container_id"),
        F.concat_ws("\0", F.lit("PATH=/bin"), image, space).alias("environ"),
    )


def syscall_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    return read(spark, sf_dir, "events").filter(F.col("event_type") != "purchase").select(
        F.concat(F.lit("p-"), n.cast("string")).alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.when(n % 7 != 0, F.concat(F.lit("c"), (user % 5).cast("string"))).alias("container_id"),
        F.lit(None).cast("string").alias("image_name"),
        F.lit(None).cast("string").alias("namespace"),
        user.alias("pid"),
        F.lit(1).cast("bigint").alias("ppid"),
        (n % 440).cast("int").alias("syscall_id"),
        F.lit("proc").alias("comm"),
        F.lit(0).cast("bigint").alias("return_value"),
        user.alias("uid"),
        F.lit("node").alias("hostname"),
    )


def network_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id"), F.col("user_id")
    codes = F.when(n % 3 == 0, 6).when(n % 3 == 1, 17).otherwise(1)
    return read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("p-"), n.cast("string")).alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.when(n % 7 != 0, F.concat(F.lit("c"), (user % 5).cast("string"))).alias("container_id"),
        F.lit(None).cast("string").alias("image_name"),
        F.lit(None).cast("string").alias("namespace"),
        user.alias("pid"),
        F.lit("proc").alias("comm"),
        (n * 7919 % F.lit(4294967296)).alias("daddr"),
        (n * 104729 % F.lit(4294967296)).alias("saddr"),
        (n % 65536).cast("int").alias("dport"),
        codes.alias("protocol_code"),
        user.alias("uid"),
        F.lit("node").alias("hostname"),
    )
