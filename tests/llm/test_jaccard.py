from pathlib import Path

import numpy as np
import pyarrow as pa
from helpers import components, documents, shingles
from pyspark.sql import functions as F

from tidewell.llm import common, jaccard


def test_components_match_all_pairs(odd):
    rows, docs = odd
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(d, n, c) for d, (n, c) in components(rows).items()}


def test_components_of_a_doubled_table(spark):
    # the whole text links with each of its ends, which don't link with each other: both links are needed
    rows = []
    for i in range(120):
        text = [f"t{i}w{j}" for j in range(9)]
        rows += [(3 * i, " ".join(text)), (3 * i + 1, " ".join(text[1:])), (3 * i + 2, " ".join(text[:-1]))]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got) == sorted((d, n, c) for d, (n, c) in components(rows).items() for _ in range(2))


def test_keep_first(odd):
    rows, docs = odd
    kept = jaccard.keep_first(docs.withColumnRenamed("source", "rep"))
    assert kept.columns == ["doc_id", "text", "lang", "rep", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in components(rows).items() if d == c}


def test_keep_first_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (7, a + " more"), (7, a + " more"), (8, a), (None, b), (None, b + " more"), (None, c), (3, ""), (3, ""), (4, None), (None, ""), (None, None)]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept if r["doc_id"]) == [(3, ""), (4, ""), (7, a + " more")]
    texts = sorted((r["text"] or "") for r in kept if not r["doc_id"])
    assert texts[:2] == ["", ""] and texts[2] in (b, b + " more") and texts[3:] == [c]


def test_empty(none):
    assert jaccard.jaccard_components(none).count() == 0


def test_bounds_and_groups_lose_no_link():
    texts = [r[1] for r in documents(8)]
    sets = [u for _, u in jaccard.shingle_sets(pa.array(texts, pa.string()))]
    packed = [jaccard.count_vector(u) if len(u) > 3 else b"" for u in sets]
    signs = [set(jaccard.signatures(u).tolist()) for u in sets]
    seen = 0
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(np.intersect1d(a, b))
            if min(len(a), len(b)) < 4 or 180 * both < 80 * (len(a) + len(b)):
                continue
            seen += 1
            assert np.array_equal(a, b) or signs[i] & signs[j]
            n = np.array([len(a), len(b)])
            points = jaccard.Points(pa.array([packed[i], packed[j]], pa.binary()), n)
            assert points.allowed(np.array([0]), np.array([1])).all()
            tree = jaccard.CountTree(points.matrix(np.arange(2)), n)
            assert [sorted(map(int, np.concatenate(p))) for p in tree.pairs()] == [[0, 1]]
            assert tree.around(0).tolist() == [1]
    assert seen > 30


def test_tree_search_is_its_self_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, (6, 64))
    whole = np.minimum(np.repeat(base, 30, axis=0) + (rng.random((180, 64)) < 0.1), 3).astype(np.uint16)
    sizes = whole.sum(axis=1).astype(np.int64) + rng.integers(0, 9, 180)
    tree = jaccard.CountTree(whole, sizes)
    both = {tuple(sorted((int(i), int(j)))) for a, b in tree.pairs() for i, j in zip(a, b, strict=True)}
    around = {tuple(sorted((i, int(j)))) for i in range(180) for j in tree.around(i)}
    assert both == around and len(both) > 500


def test_limits_change_nothing(odd):
    rows, docs = odd
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs, bucket=3, slice_bytes=2000, max_ids=0).collect()}
    assert got == {(d, c) for d, (_, c) in components(rows).items()}


def test_batches_of_few_words(spark):
    texts = [None, "", "one", "one two", "other text here", "a b c d", "a b c d e", "a b c d e f", "a b c d e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(d, n, c) for d, (n, c) in components(rows).items()}
    for n in range(len(texts)):
        assert [len(u) for _, u in jaccard.shingle_sets(pa.array(texts[n : n + 1], pa.string()))] == [len(shingles(texts[n]))]


def test_ids_near_both_ends_of_long(spark):
    top = 2**63 - 1
    text = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*text[:30], f"x{i}", *text[30:]])) for i in (top, top - 1, top - 2, -top, -top - 1, 0)]
    got = {r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-top - 1}


def test_vectors_of_large_sets_are_short(spark):
    # a vector goes to every bucket of its set, and large sets have most
    for n in (300, 1000, 4000, 20_000):
        assert 8 * len(jaccard.count_vector(np.arange(n, dtype=np.uint64))) <= 2 * n
    sizes = [1, 3, 4, 63, 64, 65, 128, 129, 256, 257, 512, 513, 1024, 1025, 2049, 40_000]
    shown = spark.createDataFrame([(n,) for n in sizes], "top long").select(F.expr(jaccard._packed_sql("top"))).collect()
    assert [r[0] for r in shown] == [len(jaccard.count_vector(np.arange(n, dtype=np.uint64))) for n in sizes]


def test_group_hashes_move_twice_and_are_kept_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99_999, 400))) for i in range(2400)]
    rows += [(3000 + i, rows[i][1] + " more") for i in range(50)]
    common.ship(spark)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    paths, store = [], spark._jsc.sc().statusStore()

    def scratch(_, name):
        paths.append(f"{tmp_path}/{name}-{len(paths)}")
        return paths[-1]

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        listed = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(listed.apply, range(listed.size()))}

    monkeypatch.setattr(common, "scratch", scratch)
    before = stages()
    found = jaccard.jaccard_components(spark.read.parquet(f"{tmp_path}/docs")).filter("doc_id != component_id").collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(3000 + i, i) for i in range(50)}
    hashes = 8 * sum(len(jaccard.signatures(u)) for _, u in jaccard.shingle_sets(pa.array([r[1] for r in rows])))
    assert 0 < sum(moved for k, moved in stages().items() if k not in before) < 4 * hashes
    assert sum(f.stat().st_size for p in paths for f in Path(p).rglob("*.parquet")) < 1.8 * hashes
