"""Every catalogue query with SQL equals DuckDB's answer on the smallest tables."""

import math
import os

import duckdb
import pytest

from chronolith.plans import catalogue, projections  # noqa: F401  projections registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    mine = catalogue.queries()[name](spark, SF)
    told = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in told.description]
    rows = sorted(tuple(plain(v) for v in r) for r in told.fetchall())
    assert sorted(names) == sorted(mine.columns)
    assert sorted(tuple(plain(v) for v in r) for r in mine.select(*names).collect()) == rows


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert catalogue.queries()[name](spark, SF).count() > 0
