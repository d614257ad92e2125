"""Registered queries: each operator on the driver tables, with its SQL oracle."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
