"""Every graph query against its SQL on the smallest tables, where they are there."""

import os

import duckdb
import pytest

from topoprofile.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def canonical(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, values.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    expected = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert canonical(got, columns) == canonical(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
