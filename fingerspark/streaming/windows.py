"""Container windows on streams, with a count cap, late events and vectors under ids of their own.

The stream's clock is its greatest event time less the allowed lateness. A window closes when the
clock reaches its end and then gives its vector. A window that reaches the count cap gives one
at once and starts anew; events that come after their window has closed give a supplementary one.
The vectors of a window are its generations 0, 1, 2 ...; all but the first carry the number in
their id, so none of them shares one.

Spark's watermark lies a horizon behind the greatest event time. Events and generations are
known that long; what is older than that is dropped. The closing times are counted from there.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from math import log2

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fingerspark.functions.fixed import (
    FREQUENCY_SYSCALLS,
    LATENESS_SECONDS,
    MAX_WINDOW_EVENTS,
    PROCESS_CREATING_SYSCALLS,
    RETENTION_DAYS,
    WINDOW_SECONDS,
)
from fingerspark.functions.scoring import stable_id
from fingerspark.functions.timing import compact_time
from fingerspark.operators.features import measured_windows

# The task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HORIZON_SECONDS = RETENTION_DAYS["processed_events"] * 24 * 3600
# Columns whose distinct values are counted in a window.
COUNTED = ("syscall", "process_name", "destination_ip", "port")
FLAGS = ("network", "privileged", "root")
STATE = "generation int, total bigint, sums string, image string"
SUMS = {
    "total_events": "bigint", **{f"n_{f}": "bigint" for f in FREQUENCY_SYSCALLS}, "n_created": "bigint",
    "n_network": "bigint", "n_privileged": "bigint", "n_root": "bigint", "process_values": "bigint",
    "syscall_values": "bigint", "address_values": "bigint", "port_values": "bigint", "named_syscalls": "bigint",
    "syscall_n_log_n": "double", "named_processes": "bigint", "process_n_log_n": "double",
    "image_name": "string", "listed": "string",
}
FOLDED = ", ".join(f"{n} {t}" for n, t in {
    "container_id": "string", "start": "timestamp", "generation": "int", **SUMS}.items())


def fresh() -> dict:
    return {**{c: {} for c in COUNTED}, **{f: 0 for f in FLAGS}}


def add(sums: dict, listed: dict[str, list], part: slice) -> None:
    """Count the values and flags of some events of a window, which come as lists by column."""
    for column in COUNTED:
        counts = sums[column]
        for value, n in Counter(listed[column][part]).items():
            if value is not None:
                counts[value] = counts.get(value, 0) + n
    for flag in FLAGS:
        sums[flag] += sum(listed[flag][part])


def in_lists(rows: pd.DataFrame) -> dict[str, list]:
    texts = rows[[*COUNTED, "image_name"]].astype(object)
    return {**texts.where(texts.notna(), None).to_dict("list"), **rows[list(FLAGS)].to_dict("list")}


def in_order(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The events of a window in one batch by time and id. Spark hands them over in pieces of any order."""
    held = list(pieces)
    if held:
        yield pd.concat(held).sort_values(["timestamp", "event_id"])


def fold(total: int, sums: dict, image: str | None) -> dict:
    """The sums that the features are made of."""
    syscalls, processes = sums["syscall"], sums["process_name"]
    return {
        "total_events": total,
        **{f"n_{feature}": syscalls.get(name, 0) for feature, name in FREQUENCY_SYSCALLS.items()},
        "n_created": sum(syscalls.get(name, 0) for name in PROCESS_CREATING_SYSCALLS),
        "n_network": sums["network"], "n_privileged": sums["privileged"], "n_root": sums["root"],
        "process_values": len(processes), "syscall_values": len(syscalls),
        "address_values": len(sums["destination_ip"]), "port_values": len(sums["port"]),
        "named_syscalls": sum(syscalls.values()), "syscall_n_log_n": sum(n * log2(n) for n in syscalls.values()),
        "named_processes": sum(processes.values()), "process_n_log_n": sum(n * log2(n) for n in processes.values()),
        "image_name": image, "listed": json.dumps([{"value": v, "n": n} for v, n in sorted(syscalls.items())]),
    }


def greater(*values: str | None) -> str | None:
    return max((x for x in values if x is not None), default=None)


def window_keeper(seconds: int, lateness_seconds: int, horizon_seconds: int,
                  max_events: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The function that carries one container window forward and gives its vectors' sums.

    State is a histogram of the current generation: at most ``max_events`` events' values. With a cap the
    order of events tells which generation they are in, so those of a window in one batch are held together;
    without one they are counted piece by piece.
    """
    ahead = (horizon_seconds - lateness_seconds) * 1000  # from the watermark to the clock, in milliseconds

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        container, start = key
        end = int(pd.Timestamp(start).timestamp() * 1000) + seconds * 1000
        watermark = state.getCurrentWatermarkMs()
        closed = watermark + ahead >= end
        generation, total, sums, image = state.get if state.exists else (0, 0, None, None)
        sums = json.loads(sums) if sums else fresh()
        out = []

        def flush() -> None:
            nonlocal generation, total, sums, image
            if total:
                out.append({"container_id": container, "start": start, "generation": generation, **fold(total, sums, image)})
                generation, total, sums, image = generation + 1, 0, fresh(), None

        if closed:
            flush()  # what was open when the window closed; the events of this batch are late
        if not state.hasTimedOut:
            for rows in batches if max_events is None else in_order(batches):
                listed, at = in_lists(rows), 0
                while at < len(rows):
                    end = len(rows) if max_events is None else min(len(rows), at + max_events - total)
                    add(sums, listed, slice(at, end))
                    total, image = total + end - at, greater(image, *listed["image_name"][at:end])
                    at = end
                    if total == max_events:
                        flush()
            if closed:
                flush()
        if state.hasTimedOut and watermark >= end:
            state.remove()  # no event of this window can come any more
        else:
            state.update((generation, total, json.dumps(sums), image))
            # A closed window stays only to number what comes late.
            state.setTimeoutTimestamp(max(end if closed else end - ahead, watermark + 1))
        if out:
            yield pd.DataFrame(out)

    return keep


def window_stream(processed: DataFrame, seconds: int = WINDOW_SECONDS, lateness_seconds: int = LATENESS_SECONDS,
                  horizon_seconds: int = HORIZON_SECONDS, max_events: int | None = MAX_WINDOW_EVENTS) -> DataFrame:
    """Vectors of container windows from a stream of processed events, with their ``generation``.

    The stream must carry a watermark on ``timestamp`` of ``horizon_seconds``, as
    :func:`~fingerspark.streaming.jobs.processed_stream` sets it. Events of one batch go by time and id.
    Without ``max_events`` there is no count cap, and a window gives one vector when it closes.
    """
    narrow = processed.select(
        "container_id", F.window("timestamp", f"{seconds} seconds")["start"].alias("start"), "timestamp", "event_id",
        "image_name", *[F.col(c).cast("string").alias(c) for c in COUNTED],
        F.coalesce(F.col("is_network_event").cast("int"), F.lit(0)).alias("network"),
        F.coalesce(F.col("is_privileged").cast("int"), F.lit(0)).alias("privileged"),
        F.coalesce((F.col("uid") == 0).cast("int"), F.lit(0)).alias("root"))
    folded = narrow.groupBy("container_id", "start").applyInPandasWithState(
        window_keeper(seconds, lateness_seconds, horizon_seconds, max_events),
        FOLDED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    placed = folded.withColumns({
        "window": F.struct("start", (F.col("start") + length).alias("end")),
        "frequencies": F.from_json("listed", "array<struct<value:string,n:bigint>>")})
    return with_generation_ids(measured_windows(placed, seconds, ("generation",)))


def with_generation_ids(vectors: DataFrame) -> DataFrame:
    """The first vector of a window has the id that tables give it; later ones add their generation."""
    identity = ["container_id", compact_time("window_start"), "window_duration_seconds"]
    return vectors.withColumn("vector_id", F.when(F.col("generation") == 0, stable_id(*identity)).otherwise(
        stable_id(*identity, "generation")))
