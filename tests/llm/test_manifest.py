"""Merkle manifest, hard negatives and the forest against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hardneg, merkle, rpforest


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_tree(leaves):
    """(root, path of (left, right) hex for each leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        level = [_digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def _plain_manifest(rows):
    """Sorted (group, o, digest, subroot, root, path), from rows (group, o, digest hex)."""
    groups = {}
    for g, o, d in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, d, o))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = _plain_tree([trees[g][0] for g in names])
    return sorted(str((g, x[3], x[2], trees[g][0], root, p + up)) for g, up in zip(names, above, strict=True) for x, p in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True))


@pytest.mark.parametrize("height", [1, 2, 3, 7])
def test_merkle_matches_plain_trees(spark, height):
    rng = random.Random(height)
    sizes = {"hot": 400, "a": 1, "b": 3, "ä": 9, "c": 10, None: 28, "z" * 300: 2, "": 27}
    rows = [(g, i * 7 - 50, _digest(f"{g}{i}"), "x") for g, n in sizes.items() for i in range(n)]
    rows += [rows[0], rows[0], ("a", None, _digest("none"), None), ("hot", None, _digest("none"), None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "grp string, o long, hexed string, path string").repartition(3)
    clashing = {"n": F.lit(1), "g": F.lit("x"), "level": F.lit(2), "up": F.lit("y"), "kept": F.lit(0.5), "odd name": F.lit(True)}
    met = merkle.manifest(table.select("grp", "o", "path", F.unhex("hexed").alias("digest")).withColumns(clashing), "grp", "o", height=height)
    assert set(met.columns) == {"grp", "o", "digest", "subroot", "root", "path", *clashing}
    got = [(r["grp"], r["o"], r["digest"].hex(), r["subroot"], r["root"], [(s["l"].hex(), s["r"].hex()) for s in r["path"]]) for r in met.collect()]
    assert sorted(map(str, got)) == _plain_manifest([r[:3] for r in rows])
    folded = met.select(merkle.fold(F.col("digest")).alias("folded"), "root").collect()
    assert all(r["folded"] == r["root"] for r in folded)


def test_merkle_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([("g", 1, b"x" * 32)], "grp string, o long, digest binary")
    row = merkle.manifest(one, "grp", "o").select("subroot", "root", "path", merkle.proof_digest().alias("proof")).first()
    assert row["subroot"] == row["root"] == (b"x" * 32).hex() and row["path"] == [] and row["proof"] == _digest("")
    assert merkle.manifest(one.limit(0), "grp", "o").count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string").repartition(3)


_ODD = [(9001, None, 1, "x"), (9002, [1.0, None, 2.0], 1, "x"), (9003, [float("nan")] * 3, 2, "x"), (9004, [float("inf")] * 3, 2, "x"), (9005, [0.0] * 6, 1, "x"), (9006, [], 1, None), (9007, [1.0] * 6, None, None), (None, [1.0] * 6, 1, None)]


def _plain_negatives(rows, scale=256):
    kept = [(i, lab, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, lab, _ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, lab, q in [x for x in kept if x[0] % 100 == 0]:
        near = sorted((-dot(q, v), i) for i, k, v in kept if k == lab and i != a)[:5]
        far = sorted((-dot(q, v), i) for i, k, v in kept if k != lab)
        for s, p in near:
            fit = [(n, i) for n, i in far if 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"max_chunk": 40, "per_pivot": 60, "rings": 7}])
@pytest.mark.parametrize("size", [1.0, 2.0**19])
def test_hard_negatives_match_all_pairs(spark, bounds, size):
    """Unequal lengths, ties, near copies of both labels, scores beyond 2^53 and every odd row."""
    rng = np.random.default_rng(4)
    rows = [(i * 4, [float(np.float32(x * size)) for x in rng.normal(size=6) * rng.uniform(0.2, 2)], int(rng.integers(0, 3)), "x") for i in range(500)]
    rows += [(5000 + i, [float(np.float32(x + 0.01 * size * (i % 3))) for x in rows[25][1]], i % 2, "x") for i in range(80)]
    table = _vectors(spark, rows + _ODD)
    prepared = hardneg.prepared(table)
    asked = prepared.filter("vec_id % 100 = 0")
    got = sorted(tuple(r) for r in hardneg.mine(asked.union(asked), prepared, **bounds).collect())
    assert got == _plain_negatives(rows + _ODD)
    assert any(r[4] > 2**53 for r in got) == (size > 1)


def test_hard_negatives_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [-1.0, 0.0], 1, "x"), (3, [0.9, 0.1], 2, "x")]
    prepared = hardneg.prepared(_vectors(spark, rows))
    got = [tuple(r) for r in hardneg.mine(prepared.filter("vec_id % 100 = 0"), prepared).collect()]
    assert got == [(0, 1, 1, 3, 65536, 230 * 256)]
    assert hardneg.mine(prepared.limit(0), prepared.limit(0)).count() == 0
    huge = hardneg.prepared(_vectors(spark, [(0, [1e30, 1.0], 1, "x"), (1, [1.0, 1.0], 1, "x")]))
    with pytest.raises(ValueError, match="64 bits"):
        hardneg.mine(huge, huge)


def test_anchors_are_not_broadcast(spark):
    """What is sent to every executor has a row a chunk; anchors' rings, pivots times as many, stay where they are."""
    rng = np.random.default_rng(5)
    prepared = hardneg.prepared(_vectors(spark, [(i, [float(x) for x in rng.normal(size=6)], i % 3, "x") for i in range(4000)]))
    index = hardneg.Index(prepared, max_chunk=400, per_pivot=600, rings=7)
    # from a small file, as the search has them
    asked = hardneg.cut(prepared.filter("vec_id % 1000 = 0").coalesce(1).withColumnRenamed("vec_id", "query_id").withColumn("floor", F.lit(-1e30)))
    lines = index._intervals(asked, False)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [n for n, line in enumerate(lines) if "BroadcastExchange" in line]
    assert at
    for n in at:
        depth = lines[n].index("BroadcastExchange")
        below = []
        for line in lines[n + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert not any("MapInArrow" in line for line in below)


def _plain_links(rows, least=0.95):
    known = {k: np.array(v, float) for k, (i, v, _, _) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    width = max(len(v) for v in known.values())
    unit = {k: np.pad(v, (0, width - len(v))) / np.linalg.norm(v) for k, v in known.items()}
    for a in known:
        for b in known:
            if a < b and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    lowest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            lowest[find(k)] = min(lowest.get(find(k), r[0]), r[0])
    return sorted((str(r[0]), links[k], str(lowest.get(find(k)))) for k, r in enumerate(rows))


@pytest.mark.parametrize("bounds", [{}, {"leaf": 40, "most": 30}])
def test_forest_finds_what_all_pairs_link(spark, bounds):
    """Exact and scaled copies, near copies, a chain, a large group in tiles and every odd row; at least 0.9 of all links, none too many."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 24))
    rows = [(3 * i, list(map(float, np.float32(v))), 1, "x") for i, v in enumerate(base)]
    rows += [(5000 + i, list(map(float, np.float32(base[7] + 0.12 * rng.normal(size=24)))), 1, "x") for i in range(150)]
    rows += [(6000 + i, list(map(float, np.float32(base[9]))), 1, "x") for i in range(120)]
    rows += [(7000, [2.0 * x for x in rows[9][1]], 1, "x"), (7001, rows[3][1] + [0.0] * 2, 1, "x")]
    rows += [(8000 + i, [float(np.cos(0.2 * i)), float(np.sin(0.2 * i))], 1, "x") for i in range(14)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rpforest.near_duplicates(_vectors(spark, rows + _ODD), **bounds).collect())
    want = _plain_links(rows + _ODD)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert sum(g[2] != w[2] for g, w in zip(got, want, strict=True)) <= 2
    kept = {r["vec_id"]: r["kept"] for r in rpforest.near_duplicates(_vectors(spark, rows[:3] + _ODD)).collect()}
    assert kept[0] and kept[9001] and kept[None]


def test_forest_of_no_rows_and_of_equal_rows(spark):
    assert rpforest.near_duplicates(_vectors(spark, _ODD[:1]).limit(0)).count() == 0
    same = [(i, [1.0, 2.0, 3.0], 1, "x") for i in range(50)] + [(3, [1.0, 2.0, 3.0], 1, "x")]
    got = rpforest.near_duplicates(_vectors(spark, same)).collect()
    assert len(got) == 51 and {(r["n_links"], r["component_id"]) for r in got} == {(50, 0)}
