"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(SF_DIR).glob("*.parquet")]

pytestmark = pytest.mark.skipif(not TABLES, reason="supplied tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows):
    def cell(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 6)
        return value

    return sorted((tuple(cell(v) for v in row) for row in rows), key=str)


def test_every_query_has_sql():
    assert set(entry.base_queries()) == set(entry.base_sql())


@pytest.mark.parametrize("name", list(entry.base_queries()))
def test_query_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    answer = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [[row[i] for i in order] for row in answer.fetchall()]
    assert comparable(df.select(*[f"`{c}`" for c in columns]).collect()) == comparable(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
