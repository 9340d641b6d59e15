"""What a stream publishes: editions when their hour has come, digests to those who asked, each once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.dates import SLOT_HOURS
from tidewell.streaming.store import Files, Parts

_SENT = "user_id long, digest string, status int"


class Editions:
    """Builds the edition of every (day, slot) of the Korean clock that falls due as batches come in, once.

    The clock is the latest time of any row so far. A batch that runs past several
    slots builds them all, and a slot in which nothing came is built by the next
    batch. ``build`` gets rows with the day, slot and time ``due`` of the edition
    whose ``window`` they lie in and returns rows with day and slot. Editions that
    stand are left alone, so a batch that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], at: str = "ts", window: dt.timedelta = dt.timedelta(days=1)):
        self.spark, self.path, self.build, self.at, self.window = spark, path, build, at, window
        self.history, self.clocks = Parts(spark, f"{path}/rows", schema), Parts(spark, f"{path}/clocks", "clock timestamp")

    def stored(self) -> set[tuple[str, str]]:
        files = Files(self.spark, f"{self.path}/editions")
        return {(d.removeprefix("day="), s.removeprefix("slot=")) for d in files.names() if d.startswith("day=") for s in files.names(d) if s.startswith("slot=")}

    def _between(self, rows: DataFrame, after, until) -> DataFrame:
        """``rows`` once for each slot due after ``after`` and up to ``until`` whose window they lie in."""
        own = F.to_date(F.col(self.at) + F.expr("interval 9 hours"))
        days = -(-self.window // dt.timedelta(days=1))
        slots = [F.struct(F.date_add(own, d).alias("day"), F.lit(s).alias("slot"), (F.date_add(own, d).cast("timestamp") + F.expr(f"interval {h - 9} hours")).alias("due")) for d in range(days + 1) for s, h in SLOT_HOURS.items()]
        met = rows.withColumn("__s", F.explode(F.array(*slots))).select(*rows.columns, "__s.day", "__s.slot", "__s.due")
        met = met.filter((F.col(self.at) <= F.col("due")) & (F.col(self.at) > F.col("due") - F.lit(self.window)) & (F.col("due") <= F.lit(until)))
        return met if after is None else met.filter(F.col("due") > F.lit(after))

    def tick(self, batch: DataFrame, number: int) -> None:
        self.history.put(batch, number)
        rows = self.history.rows().filter(F.col("batch") <= number)
        after = self.clocks.rows(before=number).agg(F.max("clock")).first()[0]
        here = rows.filter(F.col("batch") == number).agg(F.max(self.at)).first()[0]
        until = max((t for t in (after, here) if t is not None), default=None)
        if until is None:
            return
        self.clocks.put(self.spark.createDataFrame([(until,)], "clock timestamp"), number)
        if after is not None:
            rows = rows.filter(F.col(self.at) > F.lit(after - self.window))
        made = self.build(self._between(rows.drop("batch"), after, until))
        if stored := [f"{d} {s}" for d, s in self.stored()]:
            made = made.filter(~F.concat_ws(" ", F.col("day").cast("string"), "slot").isin(*stored))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "slot").parquet(f"{self.path}/editions")

    def editions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/editions")


class DigestSweep:
    """Sends waiting digests to subscribers, each (reader, digest) once.

    What was sent is kept with its status, one folder for each run of a batch. A
    batch that runs again, or digests that come again later, meet these and send
    nothing that went out; those that failed are tried again, ``attempts`` times in
    all. Sending happens in tasks: one that dies before its rows are written may
    send again.
    """

    def __init__(self, spark: SparkSession, path: str, send: Callable[[str, str], int], attempts: int = 3):
        self.spark, self.path, self.send, self.attempts = spark, path, send, attempts

    def sent(self) -> DataFrame:
        """(user_id, digest, status, batch, attempt) of all that was tried."""
        schema = f"{_SENT}, batch long, attempt int"
        return self.spark.read.schema(schema).parquet(self.path) if Files(self.spark, self.path).names() else self.spark.createDataFrame([], schema)

    def pending(self, digests: DataFrame, subscriptions: DataFrame) -> DataFrame:
        """``digests`` (user_id, digest, count, title, adult, top_id) that hold something, of readers with an endpoint, not yet sent nor given up."""
        past = self.sent().groupBy("user_id", "digest").agg(F.max(F.when(F.col("status") < 300, 1).otherwise(0)).alias("done"), F.count("*").alias("tries"))
        over = past.filter((F.col("done") == 1) | (F.col("tries") >= self.attempts)).select("user_id", "digest")
        known = subscriptions.filter("endpoint is not null and endpoint != ''").select("user_id", "endpoint").dropDuplicates(["user_id"])
        return digests.filter("count > 0").join(known, "user_id").join(over, ["user_id", "digest"], "left_anti")

    @staticmethod
    def payload(digests: DataFrame) -> DataFrame:
        """With ``body`` and ``url``: how many wait and the first one's title, unless that is for adults, which no lock screen shows."""
        shown = F.col("title").isNotNull() & ~F.coalesce("adult", F.lit(False))
        body = F.concat(F.lit("관심글 "), F.col("count").cast("string"), F.lit("개가 올라왔어요"), F.when(shown, F.concat(F.lit(" · "), F.substring("title", 1, 30))).otherwise(F.lit("")))
        return digests.withColumns({"body": body, "url": F.when(F.col("top_id").isNotNull() & shown, F.concat(F.lit("/#post-"), F.col("top_id").cast("string"))).otherwise(F.lit("/"))})

    def sweep(self, digests: DataFrame, subscriptions: DataFrame, number: int) -> None:
        send = self.send

        def out(frames):
            for f in frames:
                status = [send(e, b) for e, b in zip(f["endpoint"], f["body"], strict=True)]
                yield pd.DataFrame({"user_id": f["user_id"], "digest": f["digest"], "status": status})

        due = self.payload(self.pending(digests, subscriptions)).select("user_id", "digest", "endpoint", "body")
        attempts = len(Files(self.spark, f"{self.path}/batch={number}").names())
        due.mapInPandas(out, _SENT).write.parquet(f"{self.path}/batch={number}/attempt={attempts}")
