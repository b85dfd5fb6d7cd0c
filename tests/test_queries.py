"""Every query with SQL gives the rows of that SQL; every other one runs."""

import datetime
import decimal
from pathlib import Path

import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, str(DATA))
    found = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.columns, df.collect()) == ordered(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_runs(spark, name):
    assert contract.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns == ["a", "b", "verdict", "blocked_field", "route", "score"]
