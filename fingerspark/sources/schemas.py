"""Explicit schemas of the six telemetry tables. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fingerspark.functions.fixed import FEATURE_NAMES

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<double>": T.ArrayType(T.DoubleType()), "array<string>": T.ArrayType(T.StringType()),
    "map<string,bigint>": T.MapType(T.StringType(), T.LongType()),
}


def columns(ddl: str) -> T.StructType:
    """A schema from ``name type, ...`` text, usable before a session exists."""
    pairs = [part.split() for part in ddl.replace("string,bigint", "string;bigint").split(",")]
    return T.StructType([T.StructField(n, _TYPES[t.replace(";", ",")]) for n, t in pairs])


RUNTIME_EVENT = columns("""
    event_id string, timestamp timestamp, container_id string, pid bigint, ppid bigint,
    syscall string, syscall_id int, process_name string, args string, return_value bigint,
    destination_ip string, source_ip string, port int, protocol string, uid bigint,
    hostname string, image_name string, namespace string
""")

PROCESSED_EVENT = columns("""
    event_id string, timestamp timestamp, received_at timestamp, container_id string,
    container_name string, image_name string, namespace string, pid bigint, ppid bigint,
    syscall string, syscall_category string, process_name string, args string,
    return_value bigint, destination_ip string, source_ip string, port int, protocol string,
    uid bigint, hostname string, is_privileged boolean, is_network_event boolean
""")

_INTEGER_FEATURES = {
    "unique_process_count", "unique_syscall_count", "unique_dest_ips", "unique_dest_ports",
}

FEATURE_VECTOR = columns(
    "vector_id string, container_id string, image_name string, window_start timestamp, "
    "window_end timestamp, window_duration_seconds int, total_events bigint, "
    + ", ".join(f"{n} {'int' if n in _INTEGER_FEATURES else 'double'}" for n in FEATURE_NAMES)
    + ", features array<double>, feature_names array<string>, syscall_frequencies map<string,bigint>"
)

ANOMALY_RESULT = columns("""
    result_id string, vector_id string, container_id string, detected_at timestamp,
    anomaly_score double, is_anomalous boolean, severity string, model_version string,
    contributing_features array<string>, description string, window_start timestamp,
    window_end timestamp
""")

CONTAINER_PROFILE = columns("""
    container_id string, container_name string, image_name string, namespace string,
    first_seen timestamp, last_seen timestamp, total_events bigint, total_anomalies bigint,
    anomaly_rate double, avg_anomaly_score double, max_anomaly_score double, risk_level string
""")

ALERT = columns("""
    alert_id string, result_id string, container_id string, severity string, title string,
    description string, anomaly_score double, acknowledged boolean, acknowledged_by string,
    acknowledged_at timestamp, created_at timestamp
""")

ACKNOWLEDGEMENT = columns("alert_id string, acknowledged_by string, acknowledged_at timestamp")

MODEL_REGISTRY = columns("""
    version string, samples bigint, features int, schema_version string, drift_score double,
    trained_at timestamp, contamination double, tree_count int, offset double
""")

FOREST_NODE = columns("""
    tree_id int, node_id int, depth int, size int, feature int, threshold double
""")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: missing columns become typed nulls, others are dropped.

    Timestamps keep the flavour (with or without zone) they come in.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    flavours = (T.TimestampType, T.TimestampNTZType)

    def column(field: T.StructField) -> str:
        own = types.get(field.name)
        wanted = field.dataType
        if own is None:
            return f"CAST(NULL AS {wanted.simpleString()}) AS {field.name}"
        if own == wanted or (isinstance(own, flavours) and isinstance(wanted, flavours)):
            return field.name
        return f"CAST({field.name} AS {wanted.simpleString()}) AS {field.name}"

    return df.selectExpr(*[column(f) for f in schema.fields])
