"""Operators for preparing training data: filters, deduplication, tokens, archives and search.

Nothing outside this subpackage imports it.  Each operator takes and returns DataFrames; the
queries that apply them to the given tables are in ``queries.py``.
"""
