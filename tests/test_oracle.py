"""Every query against its SQL on the test tables, as the contract compares them."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fieldtally.plans.oracle import all_oracles
from fieldtally.plans.queries import all_queries
from tools.check_oracle import normal

NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles()) <= set(entry.queries())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "trip_date" and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, db, name):
    got, want = normal(entry.queries()[name](spark, sf).toPandas()), normal(db.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    for c in got.columns:
        assert [repr(v) for v in got[c]] == [repr(v) for v in want[c]], c
