"""Structured Streaming jobs. Each takes a streaming DataFrame; ``drained`` runs one to the end of what is there."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.streaming.store import Files, Parts, scratch

#: The calendar day of the Korean clock begins at 15 hours of universal time.
DAY_START = "15 hours"
KEPT_HOURS = 48


def file_stream(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


#: The store that processors with several states need, and the setting that names it.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_batches(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Call ``each`` with every batch of what is there and its number; batches that ``checkpoint`` knows as done don't come again."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def rewind(spark: SparkSession, checkpoint: str, sound: int | None) -> None:
    """Have a stream that starts from ``checkpoint`` run again every batch after ``sound``, the last one whose output is whole (None: all).

    The offsets of the first of them are kept and sources know what they had listed
    for the others, so the same rows come again, none of them twice or left out; the
    others may be cut into fewer batches than before.
    """
    files, last = Files(spark, checkpoint), -1 if sound is None else sound
    for log, kept in (("commits", last), ("offsets", last + 1)):
        for name in files.names(log):
            if name.isdigit() and int(name) > kept:
                files.remove(f"{log}/{name}")


def drained(spark: SparkSession, stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """What a stream has put out by the end of the files that are there, from Parquet in the shared folder.

    Each batch replaces its own folder, so one that runs again after a failure adds
    nothing. In complete mode only the last batch counts.
    """
    folder = scratch(spark, "drained")
    parts = Parts(spark, f"{folder}/out", stream.schema)
    last: list[int] = []

    def each(df: DataFrame, batch: int) -> None:
        parts.put(df, batch)
        last.append(batch)

    run_batches(stream, mode, each, checkpoint or f"{folder}/checkpoint")
    rows = parts.rows()
    if mode == "complete" and last:
        rows = rows.filter(F.col("batch") == max(last))
    return rows.drop("batch")


def day_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(day, type, n) over tumbling days of the Korean clock; events later than ``late`` don't change a day that is done."""
    day = F.window("ts", "1 day", startTime=DAY_START)
    rows = events.withWatermark("ts", late).groupBy(day.alias("w"), "type").agg(F.count("*").alias("n"))
    return rows.select(F.to_date(F.col("w.start") + F.expr("interval 9 hours")).alias("day"), "type", "n")


def sliding_counts(events: DataFrame, long: str = "10 minutes", slide: str = "5 minutes", late: str = "2 hours") -> DataFrame:
    """(start, user_id, n) over windows that overlap."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", long, slide).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "user_id", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, stop, n) of runs of a reader's events with no gap so long."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def day_visitors(events: DataFrame, late: str = "2 days") -> DataFrame:
    """One row (day, user_id) the first time a visitor is met on a day; counting them is a batch over what is put out."""
    day = F.to_date(F.col("ts") + F.expr("interval 9 hours"))
    return events.withColumn("day", day).withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "user_id"]).select("day", "user_id")


def learnt_once(items: DataFrame) -> DataFrame:
    """``items`` each time an id is met first: what a classifier learns from, so that counts only ever grow."""
    return items.dropDuplicates(["id"])


def limited_requests(events: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` events of each request of a batch, in order; requests don't span batches."""
    from pyspark.sql import Window

    w = Window.partitionBy("request").orderBy("ord")
    return events.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


_POOL = "id long, score double, image string, first long, last long, alive boolean"
#: All items of a group in one packed row: an item's place is the same in each column; ``due`` is when it goes.
_HELD = "ids binary, scores binary, images string, firsts binary, lasts binary, dues binary"
_NEVER = 2**63 - 1


def rolling_pool(ticks: DataFrame, kept_hours: int = KEPT_HOURS, inertia: float = 0.7, exempt: tuple[str, ...] = (), ties: tuple[str, ...] = (), groups: int = 256) -> DataFrame:
    """The pool after each batch of ``ticks`` (id, score, image, ts), in update mode: a row for every item that changed.

    An item keeps when it was first seen, and its image where a tick has none. A
    score rises at once and falls to 0.7 of the old and 0.3 of the new. An item that
    no tick has met for ``kept_hours`` of event time goes: a row with alive false.
    Items of ``exempt`` sources never go; ``ticks`` then has a source too. Ticks of
    one time count in the order of the columns ``ties``.

    Items share state in ``groups`` by a hash of their id, so a batch calls Python
    once a group that it meets, however many items there are; a task holds one
    group's items and its ticks of the batch. Without an id, ticks are one item.
    """
    kept, places = kept_hours * 3_600_000, [f"tie{k}" for k in range(len(ties))]

    # within the function, so that they travel to tasks with it by value
    def packed(held: dict[int, tuple]) -> tuple:
        scores, images, firsts, lasts, dues = zip(*held.values(), strict=True)
        ids, firsts, lasts, dues = (array("q", x).tobytes() for x in (held, firsts, lasts, dues))
        return ids, array("d", scores).tobytes(), json.dumps(images), firsts, lasts, dues

    def unpacked(state: tuple) -> dict[int, tuple]:
        ids, firsts, lasts, dues = (array("q", bytes(state[k])) for k in (0, 3, 4, 5))
        return dict(zip(ids, zip(array("d", bytes(state[1])), json.loads(state[2]), firsts, lasts, dues, strict=True), strict=True))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = unpacked(state.get) if state.exists else {}
        met, staying = [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["at", *places], kind="stable")
            ats = rows["at"].astype("int64")  # refuses ticks without a time
            staying = set(rows["id"][rows["stays"]].tolist())
            met = rows["id"].unique().tolist()
            for i, score, image, at in zip(rows["id"].tolist(), rows["score"].tolist(), rows["image"].tolist(), ats.tolist(), strict=True):
                old = held.get(i)
                image = image if isinstance(image, str) else None
                if old is None or (at - old[3] > kept * 1000 and i not in staying):
                    held[i] = (score, image, at, at, 0)
                else:
                    new = score if score >= old[0] else inertia * old[0] + (1 - inertia) * score
                    held[i] = (new, image if image is not None else old[1], old[2], max(at, old[3]), 0)
            for i in met:
                held[i] = (*held[i][:4], _NEVER if i in staying else max(held[i][3] // 1000 + kept, now + 1))
        gone = {i: held.pop(i) for i in [i for i, x in held.items() if x[4] < now]}
        if held:
            state.update(packed(held))
            due = min(x[4] for x in held.values())
            if due < _NEVER:
                state.setTimeoutTimestamp(max(due, now))
        else:
            state.remove()
        changed = [(i, *held[i][:4], True) for i in met] + [(i, *x[:4], False) for i, x in gone.items()]
        if changed:
            out = pd.DataFrame(changed, columns=["id", "score", "image", "first", "last", "alive"])
            yield out.assign(id=None) if key[0] < 0 else out

    group = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(groups)).cast("int"))
    stays = F.coalesce(F.col("source").isin(*exempt), F.lit(False)) if exempt else F.lit(False)
    told = ticks.withWatermark("ts", "1 hour").select(
        group.alias("group"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("score").cast("double").alias("score"), "image", "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), stays.alias("stays"), *(F.col(c).alias(p) for c, p in zip(ties, places, strict=True)),
    )
    rows = told.groupBy("group").applyInPandasWithState(update, _POOL, _HELD, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.select("id", "score", "image", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), "alive")


def publish_once(batch: DataFrame, path: str) -> None:
    """Write editions (day, slot, ...) so that running a batch again changes nothing: only their own partitions are replaced."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "slot").parquet(path)
