"""JSON on the wire: decoding messages and encoding records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.functions.fixed import UNKNOWN_KEY

MALFORMED = "malformed JSON"
# Instants travel as ISO-8601 UTC text.
ISO_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
}
_RAW = "_raw_text"


def decode_json(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Parse ``value`` into the columns of ``schema``; other message columns are kept.

    Unknown fields are ignored and missing ones are null. Text that is no JSON object
    of the schema sets ``decode_error`` and stays readable in ``raw``.
    """
    with_raw = T.StructType(schema.fields + [T.StructField(_RAW, T.StringType())])
    text = F.col(value).cast("string")
    parsed = F.from_json(text, with_raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW})
    kept = [c for c in messages.columns if c != value and c not in schema.fieldNames()]
    decoded = messages.select(*kept, text.alias("raw"), parsed.alias("parsed"))
    unusable = F.col("parsed").isNull() | F.col(f"parsed.{_RAW}").isNotNull()
    return decoded.select(
        *kept,
        "raw",
        F.when(unusable, MALFORMED).alias("decode_error"),
        *[F.col("parsed").getField(n).alias(n) for n in schema.fieldNames()],
    )


def json_of(*columns: Column | str, pretty: bool = False) -> Column:
    """One JSON object of ``columns``; nulls are written out."""
    options = {"ignoreNullFields": "false", **ISO_FORMATS}
    if pretty:
        options["pretty"] = "true"
    return F.to_json(F.struct(*columns), options)


def to_messages(records: DataFrame, key: str = "container_id") -> DataFrame:
    """Key/value messages of ``records``, keyed by container so one container stays in order."""
    return records.select(
        F.coalesce(F.col(key), F.lit(UNKNOWN_KEY)).alias("key"),
        json_of(*records.columns).alias("value"),
    )
