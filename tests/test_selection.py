"""Greedy selections against plain row-by-row versions, hand-made pages and their own rules."""

import math
import random
from collections import Counter

import pandas as pd
import pytest

from tidewell.operators import select as S


def _page(seed, n=60, sources=8, picks=True):
    rng = random.Random(seed)
    stance = {"a": "picked", "b": "picked", "c": "hated"} if picks else {}
    rows = []
    for i in range(n):
        category = rng.choice("abcdef")
        rows.append({"id": i, "score": round(rng.random(), 3), "key": f"s{rng.randrange(sources)}", "source": f"s{rng.randrange(sources)}", "category": category, "kind": rng.choice(["news", "community", "me"]),
                     "exposure": rng.randrange(4), "stance": stance.get(category), "has_picks": picks})
    return sorted(rows, key=lambda r: -r["score"])


def _plain_page(rows, limit, first_page, mix):
    left = [r for r in rows if r["stance"] != "hated"]
    left.sort(key=lambda r: -r["score"])
    picked = lambda r: r["stance"] == "picked"
    owed_p = min(math.ceil((0.6 if first_page else 0.5) * limit), sum(map(picked, left))) if rows[0]["has_picks"] else 0
    owed_o = min(math.ceil(0.2 * limit), sum(not picked(r) for r in left))
    out = []
    while len(out) < limit and left:
        keys, cats = Counter(r["key"] for r in out), Counter(r["category"] for r in out)
        got_p = sum(map(picked, out))
        got_o = len(out) - got_p
        need_p, need_o = max(0, owed_p - got_p), max(0, owed_o - got_o)

        def owed(r, need_p=need_p, need_o=need_o, room=limit - len(out)):
            return need_p + need_o < room or (need_p > 0 and picked(r)) or (need_o > 0 and not picked(r))

        def cap(r):
            base = max(1, math.ceil(0.2 * limit))
            turn = {"news": 1, "community": -1}.get(r["kind"], 0)
            return max(1, math.floor(base * (1 + turn * mix * 0.8) + 0.5)) if mix and turn else base

        def fits(r, level, keys=keys, cats=cats, got_o=got_o):
            category = cats[r["category"]] < math.ceil((0.6 if picked(r) else 0.3) * limit) and (picked(r) or not r["has_picks"] or got_o < math.ceil(0.2 * limit))
            gap = not out or r["key"] != out[-1]["key"]
            return (level > 0 or category) and (level > 1 or keys[r["key"]] < cap(r)) and (level > 2 or gap)

        for level in range(4):
            may = [r for r in left if owed(r) and fits(r, level)]
            if may:
                break
        if not may:
            break
        best = max(may, key=lambda r: r["score"] - 0.55 * math.log(1 + r["exposure"]) - 0.2 * keys[r["key"]] - 0.25 * cats[r["category"]])
        out.append(best)
        left.remove(best)
    return [r["id"] for r in out]


@pytest.mark.parametrize("seed", range(12))
def test_diverse_page_is_the_plain_one(seed):
    rows = _page(seed, picks=seed % 3 > 0, sources=3 + seed)
    frame = pd.DataFrame(rows)
    for first_page, mix in ((True, 0.0), (False, 0.0), (True, 0.8), (False, -1.0)):
        at = S.diverse_page(10, first_page, 1, mix)(frame)
        assert frame["id"].iloc[at].tolist() == _plain_page(rows, 10, first_page, mix)


def test_diverse_page_keeps_its_promises():
    rows = [{"id": f"{c}{i}", "score": 1 - i / 20, "key": f"{c}{i % 3}", "category": c, "kind": "news", "exposure": 0, "stance": s, "has_picks": True} for c, s in (("g", "picked"), ("b", None), ("h", "hated")) for i in range(8)]
    frame = pd.DataFrame(sorted(rows, key=lambda r: -r["score"]))
    ids = frame["id"].iloc[S.diverse_page(10)(frame)].tolist()
    assert len(ids) == 10 and sum(i[0] == "g" for i in ids) >= 6 and not any(i[0] == "h" for i in ids)
    assert S.diverse_page(10)(frame[frame["stance"] == "hated"]) == []


@pytest.mark.parametrize("seed", range(4))
def test_diversified_is_the_plain_one(seed):
    rows, out = _page(seed, 25), []
    pool = list(rows)
    while pool:
        def value(r, recent=tuple(out[-4:])):
            return r["score"] - sum(0.6 * (p["source"] == r["source"]) + 0.4 * (p["category"] == r["category"]) for p in recent)

        best = max(pool, key=value)
        out.append(best)
        pool.remove(best)
    frame = pd.DataFrame(rows)
    assert frame["id"].iloc[S.diversified()(frame)].tolist() == [r["id"] for r in out]


def test_round_robin_shows_every_key_and_leaves_gaps():
    rows = [{"key": f"s{k}", "source": f"s{k}", "hot": (500 - i) / 500 if k < 3 else 0.2, "exposure": 0, "weight": 1.0} for k in range(8) for i in range(10 if k < 3 else 4)]
    frame = pd.DataFrame(rows)
    at = S.round_robin()(frame)
    keys = frame["key"].iloc[at].tolist()
    assert sorted(at) == list(range(len(rows))) and set(keys[:16]) == set(frame["key"])
    assert all(a != b for a, b in zip(keys[:20], keys[1:20], strict=False))
    for k in set(keys):
        own = [i for i in at if rows[i]["key"] == k]
        assert own == sorted(own)


def test_latest_breaks_walls_and_drops_nothing():
    rows = [{"age": 0.05, "source": "wall", "prefer": 0} for _ in range(20)] + [{"age": 0.1 + 0.01 * i, "source": f"s{i}", "prefer": 0} for i in range(5)] + [{"age": 5.0, "source": "old", "prefer": 0}]
    at = S.latest()(pd.DataFrame(rows))
    sources = [rows[i]["source"] for i in at]
    assert sorted(at) == list(range(len(rows))) and sources[:7].count("wall") == 2 and sources.index("old") < 12
    few = pd.DataFrame([{"age": 5.0, "source": "a", "prefer": 0}, {"age": 2.0, "source": "b", "prefer": 0}, {"age": 0.1, "source": "c", "prefer": 0}])
    assert S.latest()(few) == [2, 1, 0]


def test_deals_stay_apart_and_keep_their_share():
    rows = [{"deal": i % 3 == 0, "ours": i == 9, "heat": i} for i in range(40)]
    at = S.deals_capped()(pd.DataFrame(rows))
    front = at[: sum(not r["deal"] for r in rows) + 4]
    kept = [i for i in front if rows[i]["deal"]]
    assert sorted(at) == list(range(40)) and 9 in kept and 39 in kept and len(kept) == 4
    assert all(abs(a - b) >= 6 for a in kept for b in kept if a < b)
    rows = [{"deal": False, "spare": False}] * 40 + [{"deal": True, "spare": True}] * 9
    at = S.deals_ensured()(pd.DataFrame(rows))
    places = [p for p, i in enumerate(at) if i >= 40]
    assert len(at) == 44 and places[0] > 5 and len(places) == 4


def test_shares_hold_their_length():
    rows = [{"chosen": i < 3, "spare": False} for i in range(10)] + [{"chosen": True, "spare": True}] * 20
    at = S.taste_ensured()(pd.DataFrame(rows))
    assert len(at) == 10 == len(set(at)) and sum(rows[i]["chosen"] for i in at) >= 5
    rows = [{"foreign": i == 25, "spare": False, "fixed": i == 10} for i in range(30)] + [{"foreign": True, "spare": True, "fixed": False}] * 3
    at = S.foreign_ensured()(pd.DataFrame(rows))
    assert len(at) == 30 == len(set(at)) and at[0] == 0 and at[10] == 10 and sum(rows[i]["foreign"] for i in at[:20]) == 2 and 25 in at[:20]


def test_slots_wait_and_keep_away():
    ads = [{"relevance": 0.9, "dest": "x", "claims": False}, {"relevance": 0.8, "dest": "y", "claims": False}, {"relevance": 0.1, "dest": "z", "claims": False}]
    rows = pd.DataFrame([{"unsafe": i == 3, "deal_dest": "y" if i == 7 else None, "ad_dest": None} for i in range(14)])
    at = S.with_slots(ads, every=6, skip=3)(rows)
    # due at 3, beside the unsafe row till 5, then waiting for the deal at 7, after which it stands
    assert [i for i in at if i >= 0] == list(range(14)) and at.index(-2) == 8 and at[at.index(-1) + 1] == 9
    assert -3 not in at


def test_issues_and_folding(spark):
    rows = [("d", 1, "k", ["a", "b"], 9, 1), ("d", 2, "k", [], 8, 2), ("d", 3, None, ["b", "c"], 7, 3), ("d", 4, None, ["a", "b", "x"], 6, 4), ("d", 5, None, ["c", "b"], 5, 5), ("e", 6, "k", [], 4, 6)]
    frame = spark.createDataFrame(rows, "edition string, id long, key string, tags array<string>, value long, ord long")
    got = {r["id"]: (r["edition"], r["issue"], r["place"]) for r in S.clustered(frame, "edition", ["value desc", "ord"]).collect()}
    assert got == {1: ("d", 0, 0), 2: ("d", 0, 1), 3: ("d", 1, 0), 4: ("d", 0, 2), 5: ("d", 1, 1), 6: ("e", 0, 0)}
    rows = [("t", 1, "u", "k", "s1", "news", 0, 1), ("t", 2, "u", "z", "s2", "news", 0, 2), ("t", 3, "v", "k", "s2", "news", 0, 3), ("t", 4, "w", "k", "s2", "news", 0, 4), ("t", 5, "x", "k", "s3", "community", 0, 5), ("t", 6, "v", "q", "s4", "news", 2, 6), ("t", 7, None, None, None, "news", None, 7)]
    frame = spark.createDataFrame(rows, "tick string, id long, url string, key string, source string, kind string, coverage long, ord long")
    got = {r["id"]: (r["coverage"], r["related"]) for r in S.folded_batch(frame, "tick").collect()}
    assert got == {1: (2, "s2,s3"), 6: (2, ""), 7: (0, "")}


def test_top_of_events_is_the_plain_one(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, f"s{rng.randrange(4)}", rng.choice([None, *"klmnop"]), rng.randrange(30), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "category string, id long, source string, key string, value long, ord long")
    want = set()
    for c in "ab":
        taken, told, n = Counter(), set(), 0
        for _, i, source, key, _, _ in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[4], r[5])):
            if n < 3 and taken[source] < 1 and (key is None or key not in told):
                want.add((c, i, n))
                n, told = n + 1, told | {key}
                taken[source] += 1
    assert {(r["category"], r["id"], r["place"]) for r in S.top_of_events(frame, "category", 3, 1).collect()} == want


def test_arranged_puts_out_whole_lists(spark):
    """Through Spark as by the kernel alone, for lists longer than any page; a limit leaves out what is beyond it and nothing else."""
    rng = random.Random(9)
    rows = [(u, u * 10_000 + i, f"s{rng.randrange(9)}", round(rng.random() * 40, 2), rng.randrange(2), i) for u, n in ((1, 900), (2, 3), (3, 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "user_id long, id long, source string, age double, prefer int, ord long").repartition(4)
    for most in (None, 700):
        got = {}
        for r in S.arranged(table, "user_id", S.latest(), ["age", "ord"], most).orderBy("user_id", "place").collect():
            got.setdefault(r["user_id"], []).append(r["id"])
        for u in (1, 2, 3):
            mine = pd.DataFrame(sorted((r for r in rows if r[0] == u), key=lambda r: (r[3], r[5])), columns=table.columns)[:most]
            assert got[u] == mine["id"].iloc[S.latest()(mine)].tolist()
            assert sorted(got[u]) == sorted(mine["id"])


def test_clusters_of_long_editions(spark):
    rng = random.Random(4)
    rows = [("e", i, f"k{rng.randrange(200)}" if i % 3 else None, [f"t{rng.randrange(60)}" for _ in range(3)], i) for i in range(450)]
    got = {r["id"]: (r["issue"], r["place"]) for r in S.clustered(spark.createDataFrame(rows, "edition string, id long, key string, tags array<string>, ord long"), "edition", ["ord"]).collect()}
    issues: list[list] = []
    for _, i, key, tags, _ in rows:
        at = next((n for n, m in enumerate(issues) if any((key and key == k) or len(set(tags) & set(t)) >= 2 for k, t in m)), len(issues))
        issues += [[]] if at == len(issues) else []
        issues[at].append((key, tags))
        assert got[i] == (at, len(issues[at]) - 1)
    few = S.clustered(spark.createDataFrame(rows, "edition string, id long, key string, tags array<string>, ord long"), "edition", ["ord"], most=50).collect()
    assert {r["id"]: (r["issue"], r["place"]) for r in few} == {i: got[i] for i in range(50)}


def test_clusters_need_no_comparison_with_all_rows_before(spark):
    """Pairs of tags kept for a few rows at a time give the same issues; thousands of issues take no time that grows with their square."""
    rng = random.Random(6)
    rows = [("e", i, None, [f"t{rng.randrange(30)}" for _ in range(rng.randrange(5))], i) for i in range(200)]
    rows += [("f", 1000 + i, None, [f"x{i}", f"y{i}", f"z{i % 7}"], i) for i in range(9000)]
    frame = spark.createDataFrame(rows, "edition string, id long, key string, tags array<string>, ord long")
    got = [{r["id"]: (r["issue"], r["place"]) for r in S.clustered(frame, "edition", ["ord"], step=step).collect()} for step in (1 << 14, 17)]
    assert got[0] == got[1] and all(got[0][1000 + i] == (i, 0) for i in range(9000))


def test_groups_come_to_a_task_many_at_a_time(spark):
    """No call a group; groups that end within, at the end of and beyond an Arrow batch are whole, and those without a key are one."""
    sizes = {None: 7, 1: 10, 2: 35, 3: 1, 4: 9, 5: 10}
    table = spark.createDataFrame([(u, 100 * (u or 0) + i, -i) for u, n in sizes.items() for i in range(n)], "user_id long, id long, at long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = S.arranged(table, "user_id", lambda c: list(range(len(c)))[::-1], ["at"])
        got = {(r["user_id"], r["id"]): r["place"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(u, 100 * (u or 0) + i): i for u, n in sizes.items() for i in range(n)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
