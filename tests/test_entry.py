"""The registered queries equal their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from scanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "embeddings", "region")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = _sorted(df.select(columns).collect())
    assert got
    if name in catalog.oracle_sql():
        found = db.sql(catalog.oracle_sql()[name])
        assert sorted(found.columns) == columns
        assert got == _sorted(found.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
