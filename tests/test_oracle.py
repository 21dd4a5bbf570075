"""Every registered query on the smallest tables, against its SQL where there is one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(table, cols):
    return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in cols])))


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = df.toArrow()
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
        return
    want = duck.sql(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(want.column_names) == cols
    assert rows_of(got, cols) == rows_of(want, cols)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 6
