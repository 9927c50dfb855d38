"""Each query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from passagework.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float | Decimal):
        return None if math.isnan(value) else round(float(value), 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df, relation = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    place = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
