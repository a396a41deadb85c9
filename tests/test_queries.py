"""Every query with a SQL counterpart against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from pagescript import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import os

    con = duckdb.connect()
    for table in TABLES:
        path = f"{SF}/{table}.parquet"
        con.execute(f"create view {table} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    number = float(value)
    return None if math.isnan(number) else round(number, 5) + 0.0


def ordered(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = plans.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = found.select(*[f"`{c}`" for c in columns]).collect()
    result = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert ordered(rows) == ordered(expected)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
    spark.catalog.clearCache()
