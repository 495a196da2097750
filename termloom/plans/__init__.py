"""Named plans over the driver's tables."""

from termloom.plans import code_queries, hierarchy_queries, release_queries, source_queries, stream_queries, valueset_queries, version_queries  # noqa: F401
from termloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
