"""What streams keep: snapshots, bounded tables, ledgers and state, batch by batch and after failures."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell.plans import streams, taste
from tidewell.streaming import jobs as J
from tidewell.streaming import stateful as P
from tidewell.streaming.delivery import DigestSweep, Editions
from tidewell.streaming.store import Damaged, Files, Parts, Snapshots, in_batches
from tidewell.streaming.tables import BoundedTable, CountLedger, DayCounts, EnrichmentQueue, newest

SF = "/root/testdata/sf0.001"
AT = dt.datetime(2024, 1, 1)


def _hours(h):
    return AT + dt.timedelta(hours=h)


def _damage(path, version):
    """Flip bytes in the middle of a data file of a version."""
    file = next(Path(path).glob(f"data/{version:012d}-*/part-*.parquet"))
    raw = bytearray(file.read_bytes())
    for i in range(len(raw) // 3, len(raw) // 3 + 8):
        raw[i] ^= 0xFF
    file.write_bytes(bytes(raw))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)


def test_snapshots_read_the_newest_whole_version(spark, tmp_path):
    path = str(tmp_path / "s")
    snaps = Snapshots(spark, path, keep=3)
    assert snaps.read() is None
    frames = [spark.createDataFrame([(i, f"x{k}", None) for i in range(k + 1)], "id long, name string, extra double").coalesce(1) for k in range(5)]
    for k in range(3):
        assert snaps.write(frames[k], k)
    assert not snaps.write(frames[4], 2) and snaps.read()[0] == 2 and snaps.read()[1].count() == 3
    frames[4].write.parquet(f"{path}/data/{3:012d}-dead")  # a writer that died before its manifest
    assert snaps.read()[0] == 2
    _damage(path, 2)
    version, rows = snaps.read()
    assert version == 1 and sorted(map(tuple, rows.collect())) == [(0, "x1", None), (1, "x1", None)]
    assert snaps.write(frames[2], 2) and snaps.read()[0] == 2
    for k in (3, 4):
        snaps.write(frames[k], k)
    assert snaps.versions() == [4, 3, 2] and {n[:12] for n in Files(spark, path).names("data")} == {f"{k:012d}" for k in (2, 3, 4)}
    for k in (2, 3, 4):
        Files(spark, path).swap_in(f"manifests/{k:012d}", "{")
    with pytest.raises(Damaged):
        snaps.read()


def test_newest_sorts_one_hour_only(spark):
    rng = random.Random(2)
    rows = [(i, _hours(rng.randrange(5)) + dt.timedelta(minutes=rng.randrange(3))) for i in range(300)] + [(900, None), (901, None)]
    table = spark.createDataFrame(rows, "id long, at timestamp")
    order = sorted(rows, key=lambda r: (r[1] or dt.datetime(1, 1, 1), r[0]), reverse=True)
    for most in (0, 1, 77, 299, 301, 302, 5000):
        assert sorted(r["id"] for r in newest(table, most, "at", "id").collect()) == sorted(r[0] for r in order[:most])


def test_bounded_tables_evict_by_number_and_age(spark, tmp_path):
    batches = [[(1, "a", _hours(0)), (2, "a", _hours(1))], [(3, "a", _hours(2)), (1, "b", _hours(3))], [(4, "a", _hours(4)), (2, "b", _hours(30))], [(1, "c", _hours(31))]]
    frames = [spark.createDataFrame(b, "id long, v string, at timestamp") for b in batches]
    log = BoundedTable(spark, str(tmp_path / "log"), "at", ties=["id"], most=3)
    seen = BoundedTable(spark, str(tmp_path / "seen"), "at", key=["id"], most=2)
    first = BoundedTable(spark, str(tmp_path / "first"), "at", key=["id"], days=1, by_first=True)
    got = {"log": [], "seen": [], "first": []}
    for n, df in enumerate(frames):
        for name, t in (("log", log), ("seen", seen), ("first", first)):
            t.update(df, n)
            t.update(df, n)  # a batch that runs again
            got[name].append(sorted((r["id"], r["v"]) for r in t.rows().collect()))
    assert got["log"] == [[(1, "a"), (2, "a")], [(1, "b"), (2, "a"), (3, "a")], [(1, "b"), (2, "b"), (4, "a")], [(1, "c"), (2, "b"), (4, "a")]]
    assert got["seen"] == [[(1, "a"), (2, "a")], [(1, "b"), (3, "a")], [(2, "b"), (4, "a")], [(1, "c"), (2, "b")]]
    # at hour 30 only what was first seen from hour 6 on stays; 2 begins anew there, and 1 at hour 31
    assert got["first"] == [[(1, "a"), (2, "a")], [(1, "b"), (2, "a"), (3, "a")], [(2, "b")], [(1, "c"), (2, "b")]]
    assert {r["id"]: r["first_at"] for r in first.rows().collect()} == {1: _hours(31), 2: _hours(30)}


def test_a_stopped_and_damaged_stream_ends_with_the_same_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(40), _hours(i / 10)) for i in range(600)]
    df = spark.createDataFrame(rows, "n long, id long, at timestamp")
    whole = in_batches(df, "n", 6, str(tmp_path / "in"))
    once = BoundedTable(spark, str(tmp_path / "once"), "at", key=["id"], ties=["n"], most=25)
    J.run_batches(whole, "append", once.update, str(tmp_path / "c1"))
    kept = lambda t: sorted((r["n"], r["id"], r["at"]) for r in t.rows().collect())
    want = kept(once)
    assert len(want) == 25

    table, check = BoundedTable(spark, str(tmp_path / "t"), "at", key=["id"], ties=["n"], most=25), str(tmp_path / "c2")

    def stops(batch, number):
        if number == 4:
            raise RuntimeError("the driver is gone")
        table.update(batch, number)

    with pytest.raises(Exception, match="the driver is gone"):
        J.run_batches(whole, "append", stops, check)
    assert table.snapshots.versions()[0] == 3
    _damage(str(tmp_path / "t"), 3)
    _damage(str(tmp_path / "t"), 2)
    table.recover(check)
    J.run_batches(whole, "append", table.update, check)
    assert kept(table) == want
    last = table.snapshots.versions()[0]
    J.run_batches(whole, "append", table.update, check)  # nothing new
    assert table.snapshots.versions()[0] == last and kept(table) == want


def test_a_ledger_counts_every_id_once(spark, tmp_path):
    ledger = CountLedger(spark, str(tmp_path / "l"), "label string, n long", ["label"])
    count = lambda df: df.groupBy("label").agg(F.count("*").alias("n"))
    batches = [[(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "a"), (None, "a")], [(4, "b"), (1, "b")]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, label string")
        for _ in range(2):
            ledger.learn(df, n, count)
    ledger.learn(spark.createDataFrame(batches[0], "id long, label string"), 0, count)  # an early batch once more
    assert {r["label"]: r["n"] for r in ledger.totals().collect()} == {"a": 2, "b": 2}
    assert sorted(r["id"] for r in ledger.ids.rows().collect()) == [1, 2, 3, 4]


def test_streamed_preferences_are_those_of_the_batch(spark):
    key = lambda r: (r["user_id"], r["ns"], r["key"])
    got = {key(r): r["weight"] for r in streams.stream_preferences(spark, SF).collect()}
    want = {key(r): r["weight"] for r in taste.online_learning(spark, SF).collect()}
    assert set(got) == set(want) and all(abs(got[k] - w) < 2e-6 for k, w in want.items())


def test_a_readers_weights_are_one_row_of_state():
    """However many weights the events of a batch name, the store is asked once and told once; state goes on where it ended."""
    import pandas as pd

    class Store:
        calls, row = 0, None

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.row

        def update(self, row):
            self.calls, self.row = self.calls + 1, row

    store, named = Store(), [f"tag\0t{i}" for i in range(500)]
    told = P.Preferences()
    told.init(store)
    batch = lambda *rows: iter([pd.DataFrame([(o, pd.Series(n).to_numpy(), pd.Series(s, dtype=float).to_numpy()) for o, n, s in rows], columns=["ord", "names", "steps"])])
    (first,) = told.handleInputRows((7,), batch((2, named[:1], [0.5]), (1, [*named, "style\0longform"], [1.0] * 501)), None)
    (second,) = told.handleInputRows((7,), batch((3, ["tag\0t0", "style\0longform"], [9.0, 3.0])), None)
    assert store.calls == 4 and len(first) == len(second) == 1
    got = dict(zip(first["names"][0], zip(first["weights"][0], first["at"][0], strict=True), strict=True))
    assert len(got) == 501 and got["tag\0t0"] == (pytest.approx(0.995 + 0.5), 2) and got["tag\0t1"] == (1.0, 1) and first["n"][0] == 2
    assert second.iloc[0].tolist() == [7, ["tag\0t0", "style\0longform"], [6.0, 2.0], [3, 3], 3]


def test_first_screens_keep_their_time(spark, tmp_path):
    m = 60_000
    rows = [
        (1, 10, 0, [1, 2, 3, 4], []),
        (1, 11, 5 * m, [9, 8, 7], []),  # pinned in front
        (1, 12, 10 * m, [9, 8, 7], [2]),  # one is gone, a new one moves up
        (1, 13, 15 * m, [6], []),  # still within the time of the first
        (1, 14, 15 * m + 1, [9, 5, 4], []),  # over; 9 was kept, so the time isn't renewed
        (1, 15, 16 * m, [30, 31, 32], []),  # so nothing is pinned; a page that shares none opens anew
        (1, 16, 20 * m, [40], []),
        (2, 17, 1 * m, [1], []),
    ]
    df = spark.createDataFrame(rows, "user_id long, request long, at long, fresh array<long>, gone array<long>")
    out = J.drained(spark, P.first_screens(in_batches(df, "request", 3, str(tmp_path / "in"))), "append")
    got = {r["request"]: (r["pinned"], r["page"], r["opened"]) for r in out.collect()}
    assert got == {
        10: ([], [1, 2, 3, 4], True), 11: ([1, 2, 3], [1, 2, 3, 9, 8, 7], False), 12: ([1, 3], [1, 3, 9, 8, 7], False), 13: ([1, 3, 9], [1, 3, 9, 6], False),
        14: ([], [9, 5, 4], False), 15: ([], [30, 31, 32], True), 16: ([30, 31, 32], [30, 31, 32, 40], False), 17: ([], [1], True),
    }


def test_day_counts_hold_their_cap(spark, tmp_path):
    rows = [(i, u, _hours(h), _hours(0)) for i, (u, h) in enumerate([(1, 0), (1, 1), (2, 2), (3, 3), (1, 24), (2, 25), (9, 20), (1, 2)])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, created_at timestamp")
    days = DayCounts(spark, str(tmp_path / "d"), cap=2)

    def twice(batch, number):
        batch = batch.persist()
        days.add(batch, number)
        days.add(batch, number)
        batch.unpersist()

    J.run_batches(P.day_visits(in_batches(df, "event_id", 3, str(tmp_path / "in"))), "append", twice, str(tmp_path / "c"))
    got = {str(r["day"]): tuple(r)[1:] for r in days.days().collect()}
    # (visitors, counted, over, fresh, returning); the Korean day of the first hours is January 1st
    assert got == {"2024-01-01": (3, 2, 1, 3, 0), "2024-01-02": (3, 2, 1, 0, 2)}


def test_the_enrichment_queue_has_a_budget(spark, tmp_path):
    items = [(1, "http://a", "A", None, "s", _hours(1)), (2, "http://b", "B", "own", "", _hours(9)), (3, "http://c", "C", None, "", _hours(5)), (4, "http://c", "C2", None, None, _hours(0)), (5, "ftp://d", "D", None, "", _hours(9)), (6, "http://e", "E", "own", "own", None), (7, None, "F", None, "", None), (8, "http://g", "G", "", "", None)]
    pages = [("http://a", "ia", "ta"), ("http://b", "ib", "B"), ("http://c", None, None), ("http://g", "ig", "broken �")]
    items = spark.createDataFrame(items, "id long, url string, title string, image string, summary string, published_at timestamp")
    pages = spark.createDataFrame(pages, "url string, image string, excerpt string")
    queue = EnrichmentQueue(spark, str(tmp_path / "q"), budget=2)
    assert [(r["url"], r["place"]) for r in queue.misses(items, AT).orderBy("place").collect()] == [("http://c", 1), ("http://a", 2)]
    got = {r["id"]: (r["image"], r["summary"]) for r in queue.cycle(items, pages, 1, AT).collect()}
    assert got == {1: ("ia", "s"), 2: ("own", ""), 3: (None, ""), 4: (None, ""), 5: (None, ""), 6: ("own", "own"), 7: (None, ""), 8: (None, "")}
    queue.cycle(items, pages, 1, AT)  # again: nothing is fetched anew
    assert {r["url"] for r in queue.cache(AT).collect()} == {"http://a", "http://c"}
    got = {r["id"]: (r["image"], r["summary"]) for r in queue.cycle(items, pages, 2, _hours(0.5)).collect()}
    assert got[8] == ("ig", "") and got[2] == ("own", "")  # a title is no summary, nor is broken text
    assert {r["url"] for r in queue.misses(items, _hours(0.9)).collect()} == set()
    assert {r["url"] for r in queue.misses(items, _hours(2)).collect()} == {"http://c"}  # nothing was found, so it is asked sooner
    assert {r["url"] for r in queue.cache(_hours(7)).collect()} == set()


def test_exempt_items_stay_in_the_pool(spark, tmp_path):
    rows = [(1, 5.0, None, _hours(0), "me"), (2, 5.0, None, _hours(0), "web"), (3, 1.0, None, _hours(60), "web"), (3, 1.0, None, _hours(61), "web"), (1, 4.0, None, _hours(62), "me")]
    df = spark.createDataFrame(rows, "id long, score double, image string, ts timestamp, source string")
    out = J.drained(spark, J.rolling_pool(in_batches(df, "ts", 3, str(tmp_path / "in")), exempt=("me",)), "update").collect()
    assert {r["id"] for r in out if not r["alive"]} == {2}
    assert max((r["last_seen"], r["score"], r["first_seen"]) for r in out if r["id"] == 1) == (_hours(62), pytest.approx(4.7), AT)


def test_the_pool_shares_state_in_groups(spark, tmp_path):
    big = 2**53 + 1
    rows = [(i, float(i), f"i{i}" if i % 2 else None, _hours(0)) for i in range(600)] + [(big, 1.0, None, _hours(0)), (None, 2.0, "n", _hours(0))]
    rows += [(7, 100.0, None, _hours(40)), (None, 1.0, None, _hours(40)), (9, 1.0, None, _hours(60)), (9, 1.0, None, _hours(61))]
    df = spark.createDataFrame(rows, "id long, score double, image string, ts timestamp")
    stream = J.rolling_pool(in_batches(df, "ts", 3, str(tmp_path / "in")))
    out = J.drained(spark, stream, "update", str(tmp_path / "c")).collect()
    last = {}
    for r in sorted(out, key=lambda r: (r["last_seen"], not r["alive"])):
        last[r["id"]] = (round(r["score"], 6), r["image"], r["first_seen"], r["last_seen"], r["alive"])
    assert len(last) == 602 and {i for i, x in last.items() if x[4]} == {7, 9, None}
    assert last[7] == (100.0, "i7", AT, _hours(40), True) and last[None] == (1.7, "n", AT, _hours(40), True)
    assert last[9][2:4] == (_hours(60), _hours(61)) and last[big] == (1.0, None, AT, AT, False)
    # a row of state for a group, not for an item: a call to Python costs far more than an item's ticks
    first = spark.read.format("statestore").option("batchId", 0).load(str(tmp_path / "c")).count()
    assert 0 < first <= 257


def test_ticks_of_one_time_count_by_their_ids(spark, tmp_path):
    rows = [(e, _hours(e // 40), 100.0 - e % 7 * 9) for e in range(120)]
    spark.createDataFrame([(d,) for d in range(10)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = {i: [x for e, _, x in rows if e * 7 % 10 == i] for i in range(0, 10, 3)}
    for i, (score, *values) in want.items():
        for x in values:
            score = x if x >= score else 0.7 * score + 0.3 * x
        want[i] = round(score, 6)
    got = {r["id"]: r["score"] for r in streams.stream_pool_kept(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i in want} == want


def test_parts_replace_themselves(spark, tmp_path):
    parts = Parts(spark, str(tmp_path / "p"), "x long")
    assert parts.rows().count() == 0
    for _ in range(2):
        parts.put(spark.range(3).select(F.col("id").alias("x")), 4)
    parts.put(spark.range(1).select(F.col("id").alias("x")), 5)
    assert parts.rows().count() == 4 and parts.rows(before=5).count() == 3


def test_editions_are_built_once(spark, tmp_path):
    built = []

    def build(due):
        rows = due.groupBy("day", "slot").agg(F.count("*").alias("n"))
        built.append(rows.count())
        return rows

    editions = Editions(spark, str(tmp_path / "e"), "id long, ts timestamp", build)
    # hours of universal time; 7, 12 and 19 o'clock in Korea are 22 of the day before, 3 and 10
    batches = [[(1, _hours(1)), (2, _hours(2))], [(3, _hours(11))], [(4, _hours(11.5))], [(5, _hours(60))]]
    frames = [spark.createDataFrame(b, "id long, ts timestamp") for b in batches]
    for n in (0, 1, 1, 2, 3, 2):
        editions.tick(frames[n], n)
    got = {(str(r["day"]), r["slot"]): r["n"] for r in editions.editions().collect()}
    # the first batch ends before any slot; the second passes two at once, the last all in which anything lies
    assert got == {("2024-01-01", "lunch"): 2, ("2024-01-01", "evening"): 2, ("2024-01-02", "morning"): 4, ("2024-01-02", "lunch"): 2, ("2024-01-02", "evening"): 2}
    assert built == [0, 2, 2, 0, 3, 0]


def test_a_digest_is_sent_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def send(endpoint, body):
        with open(f"{log}/{endpoint}", "a") as f:
            f.write(body + "\n")
        return 410 if endpoint == "bad" else 201

    sweep = DigestSweep(spark, str(tmp_path / "s"), send, attempts=2)
    people = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None), (4, ""), (5, "five"), (1, "one")], "user_id long, endpoint string")
    first = [(1, "a", 2, "t" * 40, False, 9), (2, "a", 1, "x", False, 8), (3, "a", 1, "x", False, 8), (5, "a", 0, None, None, None)]
    later = [*first, (1, "b", 1, "grown", True, 7), (5, "b", 3, None, None, None)]
    frames = [spark.createDataFrame(x, "user_id long, digest string, count long, title string, adult boolean, top_id long") for x in (first, later)]
    for n, k in ((0, 0), (0, 0), (1, 1), (1, 1), (2, 0)):
        sweep.sweep(frames[k], people, n)
    told = {p.name: p.read_text().splitlines() for p in log.iterdir()}
    assert told == {"one": ["관심글 2개가 올라왔어요 · " + "t" * 30, "관심글 1개가 올라왔어요"], "bad": ["관심글 1개가 올라왔어요 · x"] * 2, "five": ["관심글 3개가 올라왔어요"]}
    urls = {(r["user_id"], r["digest"]): r["url"] for r in sweep.payload(frames[1]).collect()}
    assert urls[1, "a"] == "/#post-9" and urls[1, "b"] == "/" == urls[5, "b"]
