"""Registered queries."""

from . import case_queries, layout_queries, rule_queries, screening_queries, search_queries, text_queries, validation_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
