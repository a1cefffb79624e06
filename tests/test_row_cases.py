"""Operators row by row, on generated tasks and on files: every case with the SQL that must give the same rows."""

import duckdb
import pytest

from row_cases import cases, fixtures, generated, stored

MODULES = (fixtures, cases, generated, stored)
EXPECTED = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_all_have_sql():
    assert QUERIES.keys() == EXPECTED.keys() and len(QUERIES) > 90


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_case(spark, name):
    found = QUERIES[name](spark, "")
    wanted = duckdb.connect().execute(EXPECTED[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in found.collect()], found.columns) == rows_of(wanted.fetchall(), columns)
