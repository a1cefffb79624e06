"""Registered queries and the SQL that they are compared with."""

from __future__ import annotations


def _modules() -> tuple:
    from pairwright.plans import scaled, tables, turns

    return scaled, tables, turns


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE_SQL.items()}
