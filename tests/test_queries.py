"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from vacanta import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, sql, name):
    want = sql.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_without_sql(spark):
    for name in queries.queries().keys() - queries.oracle_sql().keys():
        assert queries.queries()[name](spark, SF).count() > 0
