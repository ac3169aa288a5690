"""All registered queries of the training-data operators."""

from glyphgate.llm import (  # noqa: F401  (registers)
    queries_joins, queries_layout, queries_lm, queries_native, queries_negatives, queries_pages, queries_rules, queries_runs,
    queries_tokens,
)
from glyphgate.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
