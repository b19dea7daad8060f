"""The corpus pipeline: documents go through one operator after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns as Parquet in the shared folder and reads it back as the next one's documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fingerspark.llm import decontamination, jaccard, mixing, rules, secrets  # noqa: E402
from fingerspark.llm.queries import trusted_documents  # noqa: E402
from fingerspark.llm.texts import table  # noqa: E402
from fingerspark.sources.tables import durable  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like trusted text.

    Null, empty and very short texts go; repeated rows are judged alike, very long ones whole. An empty
    table stays empty; columns besides those of documents pass through, whatever they are called.
    """
    return rules.kept_by_rules(docs, trusted_documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Of rows equal in id and text one stays; texts without words, null ones too, are near nothing and
    stay. Ids may be null. Very long texts are compared whole; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not reject.

    Null and empty texts stay, repeated rows go or stay together, very long texts are scanned whole. Without
    items, or without documents, all there is stays.
    """
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret.

    Null and empty texts stay as they are; repeated rows are treated alike, very long texts scanned whole;
    an empty table stays empty.
    """
    return secrets.without_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken.

    Texts without words have size 0, null is a source of its own, equal rows are taken equally often. An
    empty table stays empty; columns called ``copies`` and ``taken`` are replaced.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
]

#: Near-duplicate classes, confirmed secrets and the balanced
#: draw have no equivalent in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
