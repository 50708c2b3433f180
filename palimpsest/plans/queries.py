"""All registered queries of the library itself."""

from palimpsest.plans import analytics_queries, arbitration_queries, conflict_queries, gate_queries, graph_queries, join_queries, learning_queries, retrieval_queries, store_queries, stream_queries, telemetry_queries, walk_queries, write_queries  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
