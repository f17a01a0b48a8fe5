"""Catalog of registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from lorekeep.plans import q_intervals, q_relational, q_retrieval, q_scoring

_MODULES = (q_retrieval, q_intervals, q_relational, q_scoring)


def queries() -> dict:
    found: dict = {}
    for m in _MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _MODULES:
        found |= m.ORACLE
    return found
