"""Stream connectors: Kafka topics and directories of files behind the same calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from fingerspark.functions.fixed import DEAD_LETTER_SUFFIX
from fingerspark.sources.schemas import RUNTIME_EVENT
from fingerspark.sources.wire import to_messages

# Records taken per poll by each stage of the telemetry flow.
POLL_RECORDS = {"runtime-events": 500, "processed-events": 1000, "feature-vectors": 100}


def kafka_read_options(servers: str, topic: str, max_records: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if max_records:
        options["maxOffsetsPerTrigger"] = str(max_records)
    return options


def kafka_write_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.compression.type": "lz4",
    }


def dead_letter_topic(topic: str) -> str:
    return topic + DEAD_LETTER_SUFFIX


def read_topic(spark: SparkSession, servers: str, topic: str,
               max_records: int | None = None) -> DataFrame:
    """Messages of a Kafka topic from its start (needs the Kafka connector jar)."""
    return (spark.readStream.format("kafka")
            .options(**kafka_read_options(servers, topic, max_records)).load())


def write_topic(records: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Writer that publishes ``records`` keyed by container."""
    return (to_messages(records).writeStream.format("kafka")
            .options(**kafka_write_options(servers, topic))
            .option("checkpointLocation", checkpoint))


def read_event_files(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """Runtime events of JSON files: one event a line, or each file one JSON array.

    A file that is one document is read by one task; keep such files small.
    """
    reader = spark.read.schema(RUNTIME_EVENT).option("multiLine", whole_documents)
    return reader.json(path)


def read_file_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "parquet",
                     glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Files of a directory as a stream; ``glob`` picks file names."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(directory)
