"""Streaming jobs over several files give what one batch gives, and forget what is due."""

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import functions as F

from tidewell.streaming import jobs as J

AT = dt.datetime(2024, 1, 1)


def _files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
        for file in Path(f"{path}/{i}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)
    return J.file_stream(spark, f"{path}/*", schema, 1)


def _ticks(spark, path, batches):
    rows = [[(i, s, image, AT + dt.timedelta(hours=h)) for i, s, image, h in b] for b in batches]
    return _files(spark, path, rows, "id long, score double, image string, ts timestamp")


def test_pool_keeps_inertia_and_forgets(spark, tmp_path):
    ticks = _ticks(spark, str(tmp_path / "in"), [[(1, 100.0, "a", 0), (2, 10.0, None, 0)], [(1, 50.0, None, 1), (2, 500.0, "b", 1)], [(3, 1.0, None, 60)], [(3, 1.0, None, 61)]])
    rows = J.drained(spark, J.rolling_pool(ticks), "update", str(tmp_path / "c")).collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r["last_seen"], not r["alive"])):
        last[r["id"], r["alive"]] = r
    assert abs(last[1, True]["score"] - 85.0) < 1e-9 and last[1, True]["image"] == "a" and last[1, True]["first_seen"] == AT
    assert last[2, True]["score"] == 500.0 and last[2, True]["image"] == "b"
    assert (1, False) in last and (2, False) in last and (3, False) not in last


def test_pool_starts_anew_after_its_time(spark, tmp_path):
    ticks = _ticks(spark, str(tmp_path / "in"), [[(1, 100.0, "a", 0), (1, 1.0, None, 49)]])
    row = J.drained(spark, J.rolling_pool(ticks), "update", str(tmp_path / "c")).first()
    assert row["score"] == 1.0 and row["image"] is None and row["first_seen"] == AT + dt.timedelta(hours=49)


def test_late_events_leave_done_days_alone(spark, tmp_path):
    # a watermark counts from the batch after the next on
    rows = [[(1, "view", 0), (2, "view", 1)], [(3, "view", 40)], [(5, "view", 41)], [(4, "view", 2), (6, "view", 42)]]
    batches = [[(i, AT + dt.timedelta(hours=h), k) for i, k, h in b] for b in rows]
    stream = _files(spark, str(tmp_path / "in"), batches, "id long, ts timestamp, type string")
    counts = {(str(r["day"]), r["n"]) for r in J.drained(spark, J.day_counts(stream), "append", str(tmp_path / "c")).collect()}
    assert counts == {("2024-01-01", 2)}


def test_publishing_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = spark.createDataFrame([("2024-01-01", "lunch", 1), ("2024-01-01", "morning", 2)], "day string, slot string, id long")
    J.publish_once(rows, path)
    J.publish_once(rows.filter("slot = 'lunch'").withColumn("id", F.col("id") + 5), path)
    J.publish_once(rows.filter("slot = 'lunch'").withColumn("id", F.col("id") + 5), path)
    assert {(r["slot"], r["id"]) for r in spark.read.parquet(path).collect()} == {("lunch", 6), ("morning", 2)}


def test_requests_are_limited(spark):
    rows = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 1)], "request string, ord long")
    assert J.limited_requests(rows).groupBy("request").count().collect() == [("a", 50), ("b", 1)]
