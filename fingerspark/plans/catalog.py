"""All registered queries. Importing this module fills the registry."""

from fingerspark.plans import (  # noqa: F401
    detection_queries,
    feature_queries,
    ingest_queries,
    model_queries,
    stream_queries,
)
from fingerspark.plans.registered import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
