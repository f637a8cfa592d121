"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows_of(columns, rows):
    return sorted(repr([row[c] for c in sorted(columns)]) for row in rows)


def test_every_query_has_its_sql():
    """Of the training-text operators some cannot be put in SQL; their own tests compare them with brute force."""
    without = set(entry_module.queries()) - set(entry_module.oracle_sql())
    assert without <= set(entry_module.TEXT_QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert {r["status"] for r in entry_module.entry(spark).collect()} == {"complete", "flagged"}


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = entry_module.queries()[name](spark, SF_DIR)
    wanted = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    spark_rows = rows_of(found.columns, [r.asDict() for r in found.collect()])
    duck_rows = rows_of(wanted.columns, [dict(zip(wanted.columns, r)) for r in wanted.fetchall()])
    assert spark_rows == duck_rows
