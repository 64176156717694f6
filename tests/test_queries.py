"""Every query with SQL against DuckDB on the smallest tables: row count, columns, values."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lectern.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and not isinstance(value, bool):
        return "nan" if math.isnan(value) else f"{value:.6f}".rstrip("0").rstrip(".")
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())


def test_every_query_without_sql_gives_rows(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf_dir).count() > 0, name


def test_flagship(spark):
    import __spark_entry__

    assert FLAGSHIP in QUERIES
    assert __spark_entry__.entry(spark).count() > 0
