"""Behavioural feature vectors: 18 numbers per container and event-time window."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    FEATURE_NAMES,
    FREQUENCY_SYSCALLS,
    MAX_WINDOW_EVENTS,
    MULTI_RESOLUTION_SECONDS,
    PROCESS_CREATING_SYSCALLS,
    WINDOW_SECONDS,
)
from fingerspark.functions.scoring import entropy_bits, stable_id
from fingerspark.functions.timing import compact_time
from fingerspark.operators.ordered import ordinal
from fingerspark.sources.schemas import FEATURE_VECTOR
from fingerspark.sources.tables import durable

# Columns whose distinct values are counted; the null syscalls count towards the total.
_DIMENSIONS = ("syscall", "process_name", "destination_ip", "port", "image_name")


def _sql_list(names: Sequence[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _value_counts(events: DataFrame, seconds: int, slide_seconds: int | None,
                  keys: Sequence[str]) -> DataFrame:
    """Count of every distinct (dimension, value) of a container window.

    Each event is unpivoted over its dimensions. Grouping by value splits a busy container
    over as many tasks as it has values, and is combined before the shuffle. Only long
    buffers are kept, so this is a hash aggregation.
    """
    slide = f"{slide_seconds} seconds" if slide_seconds else None
    placed = "window" in events.columns
    window = F.col("window") if placed else F.window("timestamp", f"{seconds} seconds", slide)
    when = "window" if placed else "timestamp"
    image = "image_name" if "image_name" in events.columns else "CAST(NULL AS STRING) AS image_name"
    narrow = events.selectExpr(
        when, "container_id", *keys, "syscall", "process_name", "destination_ip",
        "CAST(port AS STRING) AS port", image,
        "CAST(is_network_event AS INT) AS network", "CAST(is_privileged AS INT) AS privileged",
        "CAST(uid = 0 AS INT) AS root",
    )
    rows = narrow.unpivot(
        [when, "container_id", *keys, "network", "privileged", "root"], list(_DIMENSIONS), "kind", "value")
    present = rows.filter("kind = 'syscall' OR value IS NOT NULL")
    return present.groupBy(window, "container_id", *keys, "kind", "value").agg(
        F.expr("count(*) AS n"),
        F.expr("sum(network) AS network"),
        F.expr("sum(privileged) AS privileged"),
        F.expr("sum(root) AS root"),
    )


def window_features(events: DataFrame, seconds: int = WINDOW_SECONDS,
                    slide_seconds: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Feature vector per container and window (tumbling, or sliding by ``slide_seconds``).

    ``keys`` adds grouping columns, such as the chunk of a capped window. Events that carry
    a ``window`` column already are taken to be placed in it. The same two grouped
    aggregations run on tables and, in append mode, on watermarked streams. Entropies are
    folded from per-value counts, so a window travels as partial sums.
    """
    counts = _value_counts(events, seconds, slide_seconds, keys)
    return measured_windows(_folded(counts, keys), seconds, keys)


def _folded(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sums of each container window from its counts of values."""
    every, named, process = "kind = 'syscall'", "kind = 'syscall' AND value IS NOT NULL", "kind = 'process_name'"

    def total(condition: str, value: str = "n") -> str:
        return f"coalesce(sum(CASE WHEN {condition} THEN {value} END), 0)"

    n_log_n = "n * log2(CAST(n AS DOUBLE))"
    sums = {
        "total_events": total(every),
        **{f"n_{feature}": total(f"kind = 'syscall' AND value = '{name}'")
           for feature, name in FREQUENCY_SYSCALLS.items()},
        "n_created": total(f"kind = 'syscall' AND value IN ({_sql_list(PROCESS_CREATING_SYSCALLS)})"),
        "n_network": total(every, "network"),
        "n_privileged": total(every, "privileged"),
        "n_root": total(every, "root"),
        "process_values": f"count_if({process})",
        "syscall_values": f"count_if({named})",
        "address_values": "count_if(kind = 'destination_ip')",
        "port_values": "count_if(kind = 'port')",
        "named_syscalls": total(named),
        "syscall_n_log_n": total(named, n_log_n),
        "named_processes": total(process),
        "process_n_log_n": total(process, n_log_n),
        "image_name": "max(CASE WHEN kind = 'image_name' THEN value END)",
        "frequencies": f"collect_list(CASE WHEN {named} THEN struct(value, n) END)",
    }
    return counts.groupBy("window", "container_id", *keys).agg(*[F.expr(f"{sql} AS {name}") for name, sql in sums.items()])


def measured_windows(folded: DataFrame, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Feature vectors from the sums of container windows: one row of ``folded`` is one vector.

    ``folded`` has ``container_id``, ``window``, ``image_name``, ``keys``, ``total_events`` and the counts
    that the features are made of; ``frequencies`` lists the syscalls with their counts.
    """
    features = {
        **{feature: f"n_{feature} / total_events" for feature in FREQUENCY_SYSCALLS},
        "unique_process_count": "CAST(process_values AS INT)",
        "unique_syscall_count": "CAST(syscall_values AS INT)",
        "process_creation_rate": f"n_created / CAST({seconds} AS DOUBLE)",
        "unique_dest_ips": "CAST(address_values AS INT)",
        "unique_dest_ports": "CAST(port_values AS INT)",
        "network_event_ratio": "n_network / total_events",
        "syscall_entropy": entropy_bits("named_syscalls", "syscall_n_log_n", "total_events"),
        "process_entropy": entropy_bits("named_processes", "process_n_log_n", "total_events"),
        "privileged_event_ratio": "n_privileged / total_events",
        "uid_zero_ratio": "n_root / total_events",
    }
    measured = folded.selectExpr(
        "container_id", "image_name", "window.start AS window_start", "window.end AS window_end",
        f"{seconds} AS window_duration_seconds", *keys, "total_events",
        *[f"{features[name]} AS {name}" for name in FEATURE_NAMES],
        "map_from_entries(sort_array(frequencies)) AS syscall_frequencies",
    )
    return _with_vector(measured, keys)


def _with_vector(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    identity = ["container_id", compact_time("window_start"), "window_duration_seconds", *keys]
    vector = ", ".join(f"CAST({name} AS DOUBLE)" for name in FEATURE_NAMES)
    return measured.withColumns({
        "vector_id": stable_id(*identity),
        "features": F.expr(f"array({vector})"),
        "feature_names": F.expr(f"array({_sql_list(FEATURE_NAMES)})"),
    }).select(*FEATURE_VECTOR.names, *keys)


def window_chunks(events: DataFrame, seconds: int = WINDOW_SECONDS,
                  max_events: int = MAX_WINDOW_EVENTS) -> DataFrame:
    """Add ``chunk``: 0 for the first ``max_events`` events of a container window, then 1, ...

    Windows within the limit, nearly all of them, need no ordering. Only the events of
    the others are numbered, by a range partitioned running count. The list of the others
    is stored first: with its true size known, Spark broadcasts it instead of shuffling
    the events, or else joins by partitions.
    """
    window = F.window("timestamp", f"{seconds} seconds")["start"]
    placed = events.withColumn("_window", window)
    group = ["container_id", "_window"]
    sizes = placed.groupBy(*group).agg(F.count("*").alias("_size"))
    over = durable(sizes.filter(F.col("_size") > max_events).select(*group))
    if over.isEmpty():
        return events.withColumn("chunk", F.lit(0).cast("bigint"))
    within = placed.join(over, group, "left_anti").withColumn("chunk", F.lit(0).cast("bigint"))
    numbered = ordinal(placed.join(over, group, "left_semi"), group, ["timestamp", "event_id"], "_nth")
    chunk = F.floor((F.col("_nth") - 1) / F.lit(max_events))
    chunked = numbered.withColumn("chunk", chunk.cast("bigint")).drop("_nth")
    return within.unionByName(chunked).drop("_window")


def capped_window_features(events: DataFrame, seconds: int = WINDOW_SECONDS,
                           max_events: int = MAX_WINDOW_EVENTS) -> DataFrame:
    """Window features where a window that reaches ``max_events`` starts a further vector."""
    return window_features(window_chunks(events, seconds, max_events), seconds, keys=("chunk",))


def multi_resolution_features(events: DataFrame,
                              resolutions: Sequence[int] = MULTI_RESOLUTION_SECONDS) -> DataFrame:
    """The same events at several window lengths, told apart by window_duration_seconds.

    The events are read once, into counts of values at the greatest length that divides all others.
    Counts of longer windows are sums of these, and a distinct value is a row of them.
    """
    shortest = durable(_value_counts(events, gcd(*resolutions), None, ()))
    placed = shortest.withColumn("start", F.col("window.start")).drop("window")
    result = None
    for seconds in resolutions:
        counts = placed.groupBy(F.window("start", f"{seconds} seconds").alias("window"), "container_id", "kind", "value").agg(
            *[F.sum(c).alias(c) for c in ("n", "network", "privileged", "root")])
        vectors = measured_windows(_folded(counts), seconds)
        result = vectors if result is None else result.unionByName(vectors)
    return result


def fill_empty_windows(vectors: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Add a zero vector for every window without events between a container's first and last.

    Every container gets its own row of windows, laid out from its own bounds. Scalar
    features of an empty window are null, its duration and event count are 0.
    """
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    spans = vectors.groupBy("container_id").agg(
        F.min("window_start").alias("first"), F.max("window_start").alias("last"))
    spine = spans.select(
        "container_id", F.explode(F.sequence("first", "last", step)).alias("window_start"))
    empty = spine.join(
        vectors.select("container_id", "window_start"), ["container_id", "window_start"], "left_anti")
    identity = ["container_id", compact_time("window_start"), "0"]
    zeros = empty.select(
        "container_id",
        "window_start",
        (F.col("window_start") + step).alias("window_end"),
        F.lit(0).alias("window_duration_seconds"),
        F.lit(0).cast("bigint").alias("total_events"),
        stable_id(*identity).alias("vector_id"),
        F.array(*[F.lit(0.0)] * len(FEATURE_NAMES)).alias("features"),
        F.array(*[F.lit(name) for name in FEATURE_NAMES]).alias("feature_names"),
        F.create_map().cast("map<string,bigint>").alias("syscall_frequencies"),
    )
    return vectors.unionByName(zeros, allowMissingColumns=True)


def feature_rows(vectors: DataFrame) -> DataFrame:
    """One row per vector and dimension."""
    return vectors.select(
        "vector_id", "container_id", "window_start", "feature_names",
        F.posexplode("features").alias("pos", "value"),
    ).withColumn("feature", F.get("feature_names", F.col("pos"))).drop("feature_names")


def frequency_rows(vectors: DataFrame) -> DataFrame:
    """One row per vector and syscall."""
    return vectors.select(
        "vector_id", "container_id", "window_start",
        F.explode("syscall_frequencies").alias("syscall", "n"))


def stored_form(vectors: DataFrame) -> DataFrame:
    """Vectors as the flat table keeps them: scalars at six decimals, nested columns as JSON."""
    doubles = [n for n in FEATURE_NAMES if vectors.schema[n].dataType.typeName() == "double"]
    return vectors.withColumns({
        **{n: F.round(n, 6) for n in doubles},
        "features_json": F.to_json("features"),
        "syscall_frequencies_json": F.to_json("syscall_frequencies"),
    }).drop("features", "feature_names", "syscall_frequencies")


def of_stored_form(stored: DataFrame) -> DataFrame:
    """Vectors from the rows of the flat table, with their arrays and map."""
    return stored.withColumns({
        "features": F.from_json("features_json", "array<double>"),
        "feature_names": F.array(*[F.lit(n) for n in FEATURE_NAMES]),
        "syscall_frequencies": F.from_json("syscall_frequencies_json", "map<string,bigint>"),
    }).drop("features_json", "syscall_frequencies_json")
