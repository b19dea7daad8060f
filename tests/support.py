"""Small builders of events for the tests."""

from datetime import datetime, timedelta

from fingerspark.sources.schemas import PROCESSED_EVENT, RUNTIME_EVENT, conform

START = datetime(2026, 3, 20, 12, 0, 0)


def runtime(spark, rows):
    """Runtime events of dicts; missing fields are null."""
    names = RUNTIME_EVENT.names
    filled = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(filled, RUNTIME_EVENT)


def processed(spark, rows):
    names = PROCESSED_EVENT.names
    base = {"container_id": "c1", "is_privileged": False, "is_network_event": False, "uid": 1000,
            "process_name": "nginx"}
    filled = []
    for i, row in enumerate(rows):
        event = {"event_id": f"e{i:06d}", "timestamp": START + timedelta(milliseconds=i), **base, **row}
        filled.append(tuple(event.get(n) for n in names))
    return conform(spark.createDataFrame(filled, PROCESSED_EVENT), PROCESSED_EVENT)


def repeat(n, **row):
    return [dict(row) for _ in range(n)]
