"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import workload

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in sorted(TABLES.glob("*.parquet")):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def test_each_query_has_sql():
    assert set(workload.queries()) == set(workload.oracle_sql())
    assert set(workload.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_schema(spark):
    assert entry.entry(spark).columns == ["unit", "file", "item_type", "field_name", "id", "context"]


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query_agrees_with_sql(spark, db, name):
    df = entry.queries()[name](spark, str(TABLES))
    expected = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    ours = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert ours == Counter(tuple(r[i] for i in order) for r in expected.fetchall())
