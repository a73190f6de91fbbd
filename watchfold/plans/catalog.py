"""All registered queries."""

from watchfold.plans import (  # noqa: F401  (importing registers)
    detection_queries,
    evaluation_queries,
    feature_queries,
    ingest_queries,
    ledger_queries,
    modelling_queries,
    moderation_queries,
    profiling_queries,
    source_queries,
    streaming_queries,
    urlscan_queries,
)
from watchfold.plans.registry import QUERIES

__all__ = ["QUERIES"]
