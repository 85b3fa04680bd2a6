"""Registered queries. Importing this package registers all of them."""

from ethospark.plans import (  # noqa: F401
    bout_queries,
    feature_queries,
    label_queries,
    matrix_queries,
    metric_queries,
    pose_queries,
    remap_queries,
    search_queries,
    source_queries,
    window_queries,
)
from ethospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
