"""Ingestion: validate, dead-letter, normalise, categorise, de-duplicate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerspark.functions.fixed import NO_CONTAINER, NO_SYSCALL
from fingerspark.functions.scoring import stable_id
from fingerspark.functions.syscalls import (
    is_network_syscall,
    is_privileged_syscall,
    syscall_category,
)
from fingerspark.functions.timing import instant
from fingerspark.operators.keyed import first_per_key, insert_if_absent
from fingerspark.sources.schemas import PROCESSED_EVENT, RUNTIME_EVENT, conform

# Arrival order is not part of the data; the earliest event time counts as the first
# write and the remaining columns break ties, so every replay keeps the same row.
FIRST_WRITE = ("timestamp", "process_name", "syscall", "pid", "args")


# Where a message stands in its topic.
COORDINATES = ("topic", "partition", "offset")
WHITESPACE = " \t\n\r\f\v"


def _blank(name: str) -> Column:
    return F.coalesce(F.btrim(F.col(name), F.lit(WHITESPACE)), F.lit("")) == ""


def reject_reason(events: DataFrame) -> Column:
    """Why an event cannot be processed, null when it can."""
    reason = F.when(_blank("container_id"), NO_CONTAINER).when(_blank("syscall"), NO_SYSCALL)
    if "decode_error" in events.columns:
        reason = F.coalesce(F.col("decode_error"), reason)
    return reason


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(reject_reason(events).isNull()).drop("raw", "decode_error")


def dead_letters(events: DataFrame, received_at: str | datetime | Column) -> DataFrame:
    """Only the bad rows, each with its text and reason; good rows of a batch go on."""
    raw = F.col("raw") if "raw" in events.columns else F.to_json(F.struct(*RUNTIME_EVENT.names))
    carried = [c for c in events.columns
               if c not in RUNTIME_EVENT.names and c not in ("raw", "decode_error")]
    reason = reject_reason(events)
    return events.filter(reason.isNotNull()).select(
        *carried, raw.alias("raw"), reason.alias("reason"),
        instant(received_at).alias("received_at"))


def with_defaults(events: DataFrame, as_of: str | datetime | Column,
                  identity: tuple[str, ...] = RUNTIME_EVENT.names) -> DataFrame:
    """Fill a missing timestamp with ``as_of`` and a missing event_id from the content.

    ``identity`` names the columns that tell events apart; pass the message coordinates
    (topic, partition, offset) where equal events without an id must stay separate.
    """
    generated = stable_id(*identity)
    stamped = F.coalesce(F.col("timestamp"), instant(as_of).cast(events.schema["timestamp"].dataType))
    return events.withColumns({
        "event_id": F.coalesce(F.col("event_id"), generated), "timestamp": stamped})


def identity_of(events: DataFrame) -> tuple[str, ...]:
    """What the id of an event without one is made of: the message coordinates, else the content."""
    return COORDINATES if {*COORDINATES} <= {*events.columns} else tuple(RUNTIME_EVENT.names)


def enrich(events: DataFrame, received_at: str | datetime | Column) -> DataFrame:
    """Valid runtime events to processed events: lower-case syscall, category, two flags."""
    enriched = events.withColumns({
        "syscall": F.lower("syscall"),
        "syscall_category": syscall_category("syscall"),
        "is_privileged": is_privileged_syscall("syscall"),
        "is_network_event": is_network_syscall("syscall"),
        "received_at": instant(received_at),
    })
    return conform(enriched, PROCESSED_EVENT)


def first_write(events: DataFrame) -> DataFrame:
    """One row per event_id, the first written."""
    return first_per_key(events, ["event_id"], [c for c in FIRST_WRITE if c in events.columns])


def new_events(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events to append to an event table (raw or processed)."""
    order = [c for c in FIRST_WRITE if c in incoming.columns]
    return insert_if_absent(table, incoming, "event_id", order)


def process(events: DataFrame, as_of: str | datetime | Column, dedup: bool = True,
            identity: tuple[str, ...] | None = None) -> DataFrame:
    """Runtime events to processed events in one plan.

    Only events that came with an id are de-duplicated; those without one are events of
    their own, however alike. Their ids are made of the columns ``identity``: by default
    the message coordinates where the events have them, otherwise the content.
    """
    usable = valid_events(events)
    if identity is None:
        identity = identity_of(events)
    if not dedup:
        return enrich(with_defaults(usable, as_of, identity), as_of)
    named = with_defaults(first_write(usable.filter(F.col("event_id").isNotNull())), as_of, identity)
    unnamed = with_defaults(usable.filter(F.col("event_id").isNull()), as_of, identity)
    return enrich(named.unionByName(unnamed), as_of)
