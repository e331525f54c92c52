"""Registered queries over the bound test tables."""

from lorekeep.plans import (  # noqa: F401
    answer_queries,
    audit_queries,
    index_queries,
    sources_queries,
    stream_queries,
    table_queries,
    text_queries,
)
from lorekeep.plans.flagship import flagship
from lorekeep.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
