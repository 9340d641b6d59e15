"""Tables that a stream rewrites each batch: bounded by number and age, or fed from a queue with a budget."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.streaming.jobs import rewind
from tidewell.streaming.store import Parts, Snapshots


def newest(rows: DataFrame, most: int, at: str, *ties: str) -> DataFrame:
    """The ``most`` rows with the greatest ``at``, equal ones by greater ``ties``; null times are oldest.

    Rows are counted by hour, the hours before the last that fits go as wholes, and
    only rows of the one hour in which the limit falls are sorted: no task meets the
    whole table.
    """
    hour = F.coalesce(F.date_trunc("hour", at), F.lit("0001-01-01").cast("timestamp"))
    rows = rows.withColumn("__hour", hour)
    later = Window.orderBy(F.desc("__hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("__hour").agg(F.count("*").alias("__in")).withColumn("__later", F.coalesce(F.sum("__in").over(later), F.lit(0))).filter(F.col("__later") < most)
    met = rows.join(hours, "__hour")
    whole = met.filter(F.col("__later") + F.col("__in") <= most)
    order = Window.partitionBy("__hour").orderBy(F.col(at).desc_nulls_last(), *[F.desc(t) for t in ties])
    edge = met.filter(F.col("__later") + F.col("__in") > most).withColumn("__place", F.row_number().over(order))
    edge = edge.filter(F.col("__place") + F.col("__later") <= most).drop("__place")
    return whole.unionByName(edge).drop("__hour", "__in", "__later")


class BoundedTable:
    """A table that keeps at most ``most`` rows, none older than ``days``, whatever streams in.

    ``key`` names what a row is about: of its rows, old and new, one stays, with the
    newest values and, as ``first_at``, when it was met first since it last went,
    which is decided when a batch ends.
    Without a key the table is a log and every row stands. Age counts from ``at``,
    or from ``first_at`` where ``by_first``; a key that comes back after its time
    begins anew. Each batch writes a snapshot under its number, so a batch that runs
    again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, at: str, key: list[str] | None = None, ties: list[str] | None = None, most: int | None = None, days: float | None = None, by_first: bool = False):
        self.snapshots = Snapshots(spark, path)
        self.at, self.key, self.ties, self.most, self.by_first = at, key or [], ties or [], most, by_first
        self.kept = None if days is None else dt.timedelta(days=days)

    def update(self, batch: DataFrame, number: int, now: dt.datetime | None = None) -> None:
        """Add a batch and drop what is due by ``now``, the latest time of the table where that isn't given."""
        held = self.snapshots.read()
        if held is not None and held[0] >= number:
            return
        rows = batch.withColumn("first_at", F.col(self.at))
        rows = rows if held is None else held[1].unionByName(rows)
        if self.key:
            rows = self._one_a_key(rows)
        due = "first_at" if self.by_first else self.at
        if self.kept is not None:
            clock = F.lit(now) if now is not None else F.col("__now")
            rows = rows.crossJoin(F.broadcast(rows.agg(F.max(self.at).alias("__now"))))
            rows = rows.filter(F.col(due) >= clock - F.lit(self.kept)).drop("__now")
        if self.most is not None:
            rows = newest(rows, self.most, due, *self.ties, *self.key)
        self.snapshots.write(rows, number)

    def _one_a_key(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*self.key, "first_at")]
        last = F.max_by(F.struct(*others), F.struct(self.at, *self.ties)).alias("__last")
        if not self.by_first or self.kept is None:
            first = F.min("first_at")
        else:  # windows of fixed length: the next opens with the first time after one has ended
            times = F.array_sort(F.collect_set(F.coalesce("first_at", self.at)))
            first = F.aggregate(times, F.lit(None).cast("timestamp"), lambda w, t: F.when(w.isNull() | (t - w > F.lit(self.kept)), t).otherwise(w))
        return rows.groupBy(*self.key).agg(last, first.alias("first_at")).select(*self.key, *[F.col(f"__last.{c}").alias(c) for c in others], "first_at").select(*rows.columns)

    def recover(self, checkpoint: str) -> None:
        """Before a stream starts again from ``checkpoint``: batches after the newest whole snapshot are to run again."""
        held = self.snapshots.read()
        rewind(self.snapshots.spark, checkpoint, None if held is None else held[0])

    def rows(self) -> DataFrame | None:
        held = self.snapshots.read()
        return None if held is None else held[1]


_CACHE = "url string, image string, excerpt string, expires_at timestamp"


class EnrichmentQueue:
    """Fills missing images and summaries from a cache of fetched descriptions, fetching at most ``budget`` urls a cycle.

    A cached answer is used at once and costs nothing. Of the rest, urls of items
    without an image come first, then the newest items'; equal ones by id. A url is
    fetched once a cycle however many items name it. What was found is kept for
    ``found_for``, what had neither image nor text for the shorter ``nothing_for``;
    expired answers go. The cache is a snapshot a cycle, so a cycle that runs again
    fetches nothing anew.
    """

    def __init__(self, spark: SparkSession, path: str, budget: int = 20, found_for: dt.timedelta = dt.timedelta(hours=6), nothing_for: dt.timedelta = dt.timedelta(hours=1)):
        self.spark, self.snapshots, self.budget = spark, Snapshots(spark, path), budget
        self.found_for, self.nothing_for = found_for, nothing_for

    def cache(self, now: dt.datetime) -> DataFrame:
        held = self.snapshots.read()
        rows = self.spark.createDataFrame([], _CACHE) if held is None else held[1]
        return rows.filter(F.col("expires_at") > F.lit(now))

    @staticmethod
    def wanting(items: DataFrame) -> Column:
        """Whether an item lacks something and has an address to ask."""
        empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
        return (empty("image") | empty("summary")) & F.coalesce(F.lower("url").rlike("^https?://"), F.lit(False))

    def misses(self, items: DataFrame, now: dt.datetime) -> DataFrame:
        """(url, place): what this cycle fetches, in order."""
        lacking = items.filter(self.wanting(items)).join(self.cache(now).select("url"), "url", "left_anti")
        bare = F.col("image").isNull() | (F.col("image") == "")
        order = F.struct((~bare).alias("has"), (-F.unix_micros("published_at")).alias("old"), "id")
        first = lacking.groupBy("url").agg(F.min(order).alias("o")).orderBy("o.has", F.col("o.old").asc_nulls_last(), "o.id").limit(self.budget)
        return first.withColumn("place", F.row_number().over(Window.orderBy("o.has", F.col("o.old").asc_nulls_last(), "o.id"))).select("url", "place")

    def cycle(self, items: DataFrame, pages: DataFrame, number: int, now: dt.datetime) -> DataFrame:
        """``items`` (id, url, title, image, summary, published_at) with what this cycle knows.

        ``pages`` (url, image, excerpt) are what fetching gives; only the urls of
        ``misses`` are read from it, and a url that it lacks gives nothing.
        """
        held = self.snapshots.read()
        if held is None or held[0] < number:
            fetched = self.misses(items, now).join(pages.dropDuplicates(["url"]), "url", "left")
            none = F.col("image").isNull() & F.col("excerpt").isNull()
            until = F.lit(now) + F.when(none, F.lit(self.nothing_for)).otherwise(F.lit(self.found_for))
            fresh = fetched.select("url", "image", "excerpt", until.cast("timestamp").alias("expires_at"))
            self.snapshots.write(self.cache(now).unionByName(fresh), number)
        return self.filled(items, self.cache(now))

    @staticmethod
    def filled(items: DataFrame, cache: DataFrame) -> DataFrame:
        """Own images and summaries stay; an excerpt that repeats the title or is broken text isn't taken."""
        told = cache.select("url", F.col("image").alias("__image"), F.col("excerpt").alias("__text"))
        met = items.join(told, "url", "left")
        taken = F.when((F.col("__text") != F.col("title")) & ~F.contains("__text", F.lit("�")), F.col("__text"))
        own = lambda c: F.when(F.col(c) != "", F.col(c))
        return met.withColumns({"image": F.coalesce(own("image"), "__image"), "summary": F.coalesce(own("summary"), taken, F.lit(""))}).drop("__image", "__text")


class CountLedger:
    """Counts that only ever grow: every id teaches once, whatever comes twice.

    Each batch writes its ids and, last, its counts as parts under its number. A
    batch that runs again sees the ids of the batches before it only and replaces
    its own parts, so it adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, counts: str, keys: list[str], id_type: str = "long"):
        self.ids = Parts(spark, f"{path}/ids", f"id {id_type}")
        self.counts = Parts(spark, f"{path}/counts", counts)
        self.keys = keys

    def learn(self, batch: DataFrame, number: int, count: Callable[[DataFrame], DataFrame]) -> None:
        """Add ``count(rows)`` of the rows whose ``id`` no batch before has; of rows of one id the batch's first by its columns teaches."""
        known = self.ids.rows(before=number).select("id")
        rest = [c for c in batch.columns if c != "id"]
        fresh = batch.filter("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*").join(known, "id", "left_anti")
        self.ids.put(fresh.select("id"), number)
        taught = self.ids.rows().filter(F.col("batch") == number).select("id")
        self.counts.put(count(fresh.join(taught, "id", "left_semi")), number)

    def totals(self) -> DataFrame:
        """The counts of all batches together."""
        sums = [c for c in self.counts.schema.names if c not in (*self.keys, "batch")]
        return self.counts.rows().groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in sums])


class DayCounts:
    """Visitors of each day from rows (user_id, day, fresh), each reader once a day: additive parts, with a cap on how many a day counts."""

    def __init__(self, spark: SparkSession, path: str, cap: int = 100_000):
        self.parts, self.cap = Parts(spark, path, "day date, visitors long, fresh long"), cap

    def add(self, visits: DataFrame, number: int) -> None:
        self.parts.put(visits.groupBy("day").agg(F.count("*").alias("visitors"), F.count_if("fresh").alias("fresh")), number)

    def days(self) -> DataFrame:
        """(day, visitors, counted, over, fresh, returning): ``over`` is how many the cap leaves out; new readers are all counted."""
        rows = self.parts.rows().groupBy("day").agg(F.sum("visitors").alias("visitors"), F.sum("fresh").alias("fresh"))
        counted = F.least(F.col("visitors"), F.lit(self.cap))
        return rows.select("day", "visitors", counted.alias("counted"), (F.col("visitors") - counted).alias("over"), "fresh", F.greatest(F.lit(0), counted - F.col("fresh")).alias("returning"))
