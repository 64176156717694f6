"""The package's queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lectern.llm.registry import ORACLES, QUERIES


def plain(value):
    return f"{value:.9f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir):
    duck = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    own = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert own == expected
