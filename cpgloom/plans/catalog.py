"""Collects all registered queries."""

from cpgloom.plans import board_queries, fitted_queries, impute_queries, matrix_queries, metric_queries, model_queries, report_queries, wide_queries  # noqa: F401
from cpgloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
