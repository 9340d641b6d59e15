"""First screens of odd requests against the SQL of the same table."""

import duckdb

from tidewell import catalog

SF = "/root/testdata/sf0.001"


def test_requests_without_a_reader_and_repeated_ones(spark, tmp_path):
    """of requests without a reader only the first has a page; repeated requests and one reader's many are those of the SQL."""
    whose = "CASE WHEN event_id % 20 = 7 THEN NULL ELSE user_id % 3 END AS user_id"
    duckdb.sql(f"COPY (SELECT event_id, ts, {whose}, event_type, value, props FROM range(2), '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    columns = "user_id", "request", "pinned", "first", "opened"
    asked = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES['home_anchors']})").fetchall()
    got = [tuple(r[c] for c in columns) for r in catalog.QUERIES["home_anchors"](spark, str(tmp_path)).collect()]
    assert sum(r[0] is None for r in got) == 1
    assert sorted(got, key=str) == sorted(asked, key=str)
