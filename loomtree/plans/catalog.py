"""The registry of queries, filled by the modules that define them."""

from __future__ import annotations

from . import search_queries, session_queries, text_queries, tree_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_h"


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
