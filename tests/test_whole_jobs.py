"""Queries without SQL of their own, against plain counts of the tables."""

import duckdb

from tidewell import catalog

SF = "/root/testdata/sf0.001"


def test_uniques_estimate(spark):
    exact = dict(
        duckdb.sql(f"SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR), count(DISTINCT user_id) FROM '{SF}/events.parquet' GROUP BY 1").fetchall()
    )
    got = {r["day"]: r["visitors"] for r in catalog.QUERIES["uniques_estimate"](spark, SF).collect()}
    # sketches of 2^12 cells: three standard errors are about 5 %
    assert set(got) == set(exact) and all(abs(got[d] - n) <= max(1, 0.05 * n) for d, n in exact.items())
