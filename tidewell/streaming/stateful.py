"""Processors with state of their own for each key: preferences that fade as they are learnt, pinned first screens, day visitors.

They run under transformWithState; ``run_batches`` starts a stream with the store
that it needs. State is one row a reader and lives on executors.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators import taste as U

UPDATES = "user_id long, names array<string>, weights array<double>, at array<long>, n long"


def moves(events: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, ord, names, steps) of events (user_id, id, ord, step): the weights that each moves, as ns, a NUL and key, and how far, by a join with the items.

    Events of step 0 and of unknown items move nothing and are left out.
    """
    def part(ns: str, key: Column, share: float | Column) -> Column:
        return F.struct(F.concat(F.lit(ns + U.NUL), key).alias("name"), (F.col("step") * share).cast("double").alias("step"))

    tags = F.transform("tags", lambda t: part("tag", t, 1.0))
    length = U.style(F.col("words")) * 0.3
    rest = F.array(part("category", F.col("category"), 0.25), part("source", F.col("source"), 0.7), part("style", F.when(length != 0, F.lit("longform")), length))
    kept = F.filter(F.concat(rest, tags), lambda m: m["name"].isNotNull())
    met = events.filter("step != 0").join(items.select("id", "category", "source", "tags", "words"), "id").select("user_id", "ord", kept.alias("m"))
    return met.select("user_id", "ord", F.col("m.name").alias("names"), F.col("m.step").alias("steps"))


class Preferences(StatefulProcessor):
    """A reader's weights, moved by each event in order and faded only when they are met.

    State holds (weight, the reader's event at which it was last moved) of all of a
    reader's weights in one packed row, which a batch reads and writes once, whatever
    its events name: a call to the store for each weight would take far longer than
    the moves. Puts out a row with every weight that a batch moved and the reader's
    number of events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "n long, names string, weights binary, at binary")
        self.move, _ = U.fold_steps()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.kept.get()
        before = n = kept[0] if kept else 0
        held = dict(zip(json.loads(kept[1]), zip(array("d", kept[2]), array("q", kept[3]), strict=True), strict=True)) if kept else {}
        frames = list(rows)
        met = sorted((x for f in frames for x in zip(f["ord"], f["names"], f["steps"], strict=True)), key=itemgetter(0))
        for _, named, steps in met:
            n += 1
            self.move(held, named, steps.tolist(), n)
        weights, ats = zip(*held.values(), strict=True)
        self.kept.update((n, json.dumps(list(held)), array("d", weights).tobytes(), array("q", ats).tobytes()))
        moved = [(name, *x) for name, x in held.items() if x[1] > before]
        names, weights, ats = (list(x) for x in zip(*moved, strict=True))
        yield pd.DataFrame({"user_id": [key[0]], "names": [names], "weights": [weights], "at": [ats], "n": [n]})

    def close(self) -> None:
        pass


def preference_updates(moved: DataFrame) -> DataFrame:
    """The stream of weights that change as readers' ``moves`` come in, in update mode: a row for each reader that a batch meets."""
    return moved.groupBy("user_id").transformWithStateInPandas(Preferences(), UPDATES, "Update", "None")


def current_weights(updates: DataFrame) -> DataFrame:
    """(user_id, ns, key, weight) now, from all ``updates`` so far: the last of each weight, faded to its reader's last event.

    Updates meet at their reader whole and are only taken apart there.
    """
    whole = Window.partitionBy("user_id")
    rows = updates.repartition("user_id").withColumn("last", F.max("n").over(whole))
    own = rows.select("user_id", "last", F.explode(F.arrays_zip("names", "weights", "at")).alias("w"))
    kept = own.groupBy("user_id", F.col("w.names").alias("name")).agg(F.max_by("w.weights", "w.at").alias("weight"), F.max("w.at").alias("at"), F.max("last").alias("last"))
    name = F.split("name", U.NUL, 2)
    kept = kept.select("user_id", name[0].alias("ns"), name[1].alias("key"), "weight", "at", "last")
    weight = U.faded(F.col("ns"), F.col("weight"), F.col("last") - F.col("at"))
    return kept.select("user_id", "ns", "key", weight.alias("weight")).filter("weight != 0 or ns = 'style'")


PINS, PIN_MILLIS = 3, 15 * 60_000
PINNED = "user_id long, request long, pinned array<long>, page array<long>, opened boolean"


class FirstScreen(StatefulProcessor):
    """Keeps the first ids of a reader's home page in place for a quarter of an hour from when they were first shown.

    The window opens with a page whose first ids share none with those kept, and
    what follows doesn't renew it: a page that shares one keeps its time, so that
    even ids that are replaced one by one end with it. Ids that a request names as
    gone are no longer pinned.
    """

    def __init__(self, pins: int = PINS, millis: int = PIN_MILLIS, size: int = 20):
        self.pins, self.millis, self.size = pins, millis, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ids array<long>, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(rows)).sort_values(["at", "request"], kind="stable")
        ids, since = ([int(i) for i in self.kept.get()[0]], int(self.kept.get()[1])) if self.kept.exists() else ([], None)
        out = []
        for request, at, fresh, gone in zip(met["request"], met["at"], met["fresh"], met["gone"], strict=True):
            gone = {int(i) for i in gone} if gone is not None else set()
            live = since is not None and at - since <= self.millis
            pinned = [i for i in ids if i not in gone][: min(self.pins, max(0, self.size - 1))] if live else []
            page = (pinned + [int(i) for i in fresh if int(i) not in pinned])[: self.size]
            first = page[: self.pins]
            opens = not set(first) & set(ids) or since is None
            ids, since = first, int(at) if opens else since
            out.append((key[0], request, pinned, page, opens))
        if since is not None:
            self.kept.update((ids, since))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PINNED.split(", ")])

    def close(self) -> None:
        pass


def first_screens(requests: DataFrame, pins: int = PINS, millis: int = PIN_MILLIS, size: int = 20) -> DataFrame:
    """(user_id, request, pinned, page, opened) of requests (user_id, request, at in milliseconds, fresh ids, gone ids)."""
    return requests.groupBy("user_id").transformWithStateInPandas(FirstScreen(pins, millis, size), PINNED, "Append", "None")


VISITS = "user_id long, day date, fresh boolean"


class DayVisits(StatefulProcessor):
    """One row the first time a reader is met on a day; ``fresh`` where that is the day the reader was created.

    A reader's state is the day of creation and the days met within ``kept`` of the
    last, so days may come in any order.
    """

    def __init__(self, kept: int = 400):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "created int, days array<int>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(rows))
        created, days = (self.seen.get()[0], set(self.seen.get()[1])) if self.seen.exists() else (None, set())
        told = met["created"].dropna()
        if created is None and len(told):
            created = int(told.min())
        new = sorted({int(d) for d in met["day_no"]} - days)
        days |= set(new)
        self.seen.update((created, sorted(d for d in days if d > max(days) - self.kept)))
        if not new:
            return
        first = pd.Timestamp("1970-01-01")
        yield pd.DataFrame({"user_id": [key[0]] * len(new), "day": [(first + pd.Timedelta(days=d)).date() for d in new], "fresh": [d == created for d in new]})

    def close(self) -> None:
        pass


def day_visits(events: DataFrame) -> DataFrame:
    """(user_id, day, fresh) of events (user_id, ts, created_at): each reader once a day of the Korean clock, new on the day of creation."""
    number = lambda c: F.unix_date(F.to_date(F.col(c) + F.expr("interval 9 hours")))
    rows = events.filter("user_id is not null").select("user_id", number("ts").alias("day_no"), number("created_at").alias("created"))
    return rows.groupBy("user_id").transformWithStateInPandas(DayVisits(), VISITS, "Append", "None")
