"""Queries over the given tables, composed from the operators."""

from . import contest_queries, label_queries, plugin_queries, rule_queries, run_queries, sequence_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
