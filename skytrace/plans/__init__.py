"""Registered queries over the test tables."""

from skytrace.plans import (  # noqa: F401
    audit_queries, feature_queries, metric_queries, report_queries, scalar_queries, source_queries, stream_queries,
)
from skytrace.plans.registry import QUERIES  # noqa: F401
