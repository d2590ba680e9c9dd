"""Every registered query against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from tagloom.plans import catalog
from tagloom.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return float(value)
    return value


def ordered(names, rows):
    places = [names.index(n) for n in sorted(names)]
    return sorted(([plain(row[p]) for p in places] for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(ORACLES) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = catalog.queries()[name](spark, SF)
    got = ordered(result.columns, [tuple(row) for row in result.collect()])
    cursor = duck.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(names)
    assert got == ordered(names, cursor.fetchall())
