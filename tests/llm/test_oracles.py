"""Queries with SQL give what DuckDB gives over the same tables."""

import duckdb
import pytest

from tidewell.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    asked = con.execute(registry.ORACLES[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in asked.fetchall())
