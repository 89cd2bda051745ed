"""All queries of the library's core and their SQL."""

from __future__ import annotations

from ledgerloom.plans import contract_sql, core_queries, reference_queries, reference_sql

_QUERIES = [core_queries, reference_queries]
_ORACLES = [core_queries, contract_sql, reference_sql]


def queries() -> dict[str, core_queries.Query]:
    return {name: f for module in _QUERIES for name, f in module.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {name: sql for module in _ORACLES for name, sql in module.ORACLE.items()}
