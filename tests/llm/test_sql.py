"""Every query of the subpackage that has SQL gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__
from copperline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    expected = duck.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected)) and rows
