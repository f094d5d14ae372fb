"""All queries on the driver's tables."""

from __future__ import annotations

from braidwork.plans import registry
from braidwork.plans import format_queries, graph_queries, interval_queries, omnitig_queries, report_queries, sequence_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracles():
    return dict(registry.ORACLES)
