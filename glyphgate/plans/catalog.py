"""All registered queries."""

from glyphgate.plans import more_queries, stream_queries, text_queries, usage_queries  # noqa: F401  (registers)
from glyphgate.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
