"""Similar readers at size: what is shuffled, ties, and rounding as the SQL does it."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from tidewell.operators import taste as U
from tidewell.plans import taste

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_pairs_are_not_shuffled(spark):
    """tasks read the two blocks that they multiply; none is copied to others through an exchange."""
    plan = _plan(taste.cosine_pairs(spark, SF))
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_sixth_places_are_rounded_as_in_sql(spark):
    values = [(k * 1000 + 500) / 1e9 for k in range(-3000, 3000, 7)]
    want = [r[0] for r in duckdb.sql(f"SELECT round(unnest({values}::DOUBLE[]), 6)").fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", taste._sixth(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in sorted(rows)] == want
    assert want != [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 6)).collect()]


def test_neighbours_are_found_without_all_pairs(spark):
    """each task puts out the best of its readers only, which one exchange brings together; many equal readers are told apart by id."""
    rng = random.Random(5)
    rows = [(u, "tag", f"t{k}", rng.choice([-0.5, 0.5, 1.25])) for u in range(40) for k in rng.sample(range(12), 4)]
    rows += [(100 + u, ns, key, w) for u in range(40) for ns, key, w in (("tag", "t1", 0.5), ("category", "c1", 0.5 if u % 2 else -0.5))]
    rows += [(u, "category", f"c{u % 3}", 0.5 if u % 2 else -0.5) for u in range(38)]
    table = spark.createDataFrame(rows, "user_id long, ns string, key string, weight double")
    near = {}
    for r in U.cosines(table).collect():
        sim = round(r["sim"], 9)
        if sim > 0:
            near.setdefault(r["a"], []).append((-sim, r["b"]))
            near.setdefault(r["b"], []).append((-sim, r["a"]))
    want = {(u, other, -sim, place) for u, x in near.items() for place, (sim, other) in enumerate(sorted(x)[:10], 1)}
    for size in (None, 7):
        assert {tuple(r) for r in U.nearest(table, size=size).collect()} == want
    plan = _plan(taste.neighbors_topk(spark, SF))
    assert "Generate" not in plan and re.findall(r"Exchange (\w+)\((\w+)#", plan) == [("hashpartitioning", "user_id")]


def test_ratings_of_neighbours_travel_in_one_row(spark):
    """no exchange of a row for each item and neighbour; 0 and unknown signals count for nothing, an unknown item is one."""
    near = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 0.5, 2), (4, 2, 0.2, 1), (4, 3, 0.1, 2)], "user_id long, other long, sim double, place int")
    ratings = spark.createDataFrame([(2, 7, 1), (2, 8, 0), (2, 9, None), (2, None, -1), (3, 7, -1), (3, 8, 1)], "user_id long, id long, signal int")
    boosts = U.collab_boosts(near, ratings)
    got = {(r["user_id"], r["id"]): round(r["boost"], 9) for r in boosts.collect()}
    assert got == {(1, 7): 0.45, (1, None): -0.3, (1, 8): 0.3, (4, 7): 0.12, (4, None): -0.06}
    plan = _plan(boosts)
    assert re.search(r"hashpartitioning\(user_id#\d+L,? *\d*\)", plan) and not re.search(r"hashpartitioning\(user_id#\d+L, [a-z_]", plan)
