"""Top-k, WARC and the pipeline."""

import random

import numpy as np
import pytest
from helpers import components, repeated_lines
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import topk, warc


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-9, 9, 12)]) for i in range(1500)]
    vectors += [(2000 + i, vectors[5][1]) for i in range(40)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    odd = [(5000, None), (5001, [1.0, None] * 6), (5002, [float("nan")] * 12), (5003, [float("inf")] * 12)]
    table = topk.quantised(table.union(spark.createDataFrame(odd, table.schema)))
    asked = table.filter("vec_id % 20 = 0")
    small = {"block": 16, "chunk_bytes": 16 * 12 * 8 * 3, "group": 10}
    got, cut_up = ({(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(asked.union(asked), table, **x).collect()} for x in ({}, small))
    ids, m = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors]) * 64
    want = {}
    for i in np.flatnonzero(ids % 20 == 0):
        best = sorted((-int(s), int(d)) for d, s in zip(ids, m @ m[i], strict=True) if d != ids[i])[:20]
        want |= {(int(ids[i]), n): (d, -s) for n, (s, d) in enumerate(best, 1)}
    assert got == cut_up == want
    few = topk.top_k(asked.limit(1), table.limit(7), 20).collect()
    assert len(few) in (6, 7)
    assert topk.top_k(table.limit(0), table).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("aäß\n<") for _ in range(3000))
    rows = [(1, "http://a/", long, "x"), (2, None, long, "x"), (3, "b\r\nc", long, None), (4, "d", "short", "x"), (5, "d", "short", "x"), (6, "", None, "x"), (7, "", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    warc.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    index = {r["record_no"]: (r["record_type"], r["refers_to"]) for r in warc.read_index(spark, str(tmp_path / "w")).collect()}
    assert index == {1: ("revisit", 3), 2: ("revisit", 3), **{i: ("response", None) for i in (3, 4, 5, 6, 7)}}
    for r in warc.read_records(spark, str(tmp_path / "w")).collect():
        body = (rows[r["record_no"] - 1][2] or "").encode()
        assert bytes(r["payload"]) == body
        assert bytes(r["record"]) == r["header"].encode() + (body if index[r["record_no"]][0] == "response" else b"") + b"\r\n\r\n"
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_index(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {r[0] for r in before}
            break
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language":
            assert len(kept) >= 0.98 * sum(bool(r[1]) for r in before)
        if name == "lines":
            gone = repeated_lines(before)
            assert all((d, i) not in gone for d, t in kept.items() if t == dict((r[0], r[1]) for r in before)[d] for i in range(len(t.split("\n"))))
        if name == "near_duplicates":
            assert set(kept) == {d for d, (_, c) in components(before).items() if d == c}
        docs = after
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_top_k_of_large_components(spark):
    """Beyond 53 bits scores stay exact; what 64 can't hold is refused."""
    rng = np.random.default_rng(6)
    for most in (2**20, 2**23):
        vectors = [(i, [float(x) for x in rng.integers(-most, most, 12)]) for i in range(400)]
        vectors += [(1000 + i, [x + float(i % 2) for x in vectors[0][1]]) for i in range(40)]
        table = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table.filter("vec_id % 20 = 0"), table, block=16, chunk_bytes=16 * 12 * 8 * 3).collect()}
        whole = {i: [int(x) * 64 for x in v] for i, v in vectors}
        want = {}
        for q in (i for i in whole if i % 20 == 0):
            best = sorted((-sum(x * y for x, y in zip(whole[q], v, strict=True)), d) for d, v in whole.items() if d != q)[:20]
            want |= {(q, n): (d, -s) for n, (s, d) in enumerate(best, 1)}
        assert got == want and max(s for _, s in got.values()) > 2**53
    huge = topk.quantised(spark.createDataFrame([(0, [1e9] * 12), (1, [1e9] * 12)], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(huge, huge)


def test_warc_of_rows_without_key(spark, tmp_path):
    long = "x" * 2000
    rows = [(None, "http://a/", long), (5, "http://b/", long), (None, "http://c/", "y" * 1500), (None, None, "z"), (5, "http://b/", long), (4, "d", long)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    index = sorted((str(r["record_no"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in warc.read_index(spark, str(tmp_path / "w")).collect())
    assert index == [("4", 2000, "revisit", "5"), ("5", 2000, "response", "None"), ("5", 2000, "response", "None"), ("None", 1, "response", "None"), ("None", 1500, "response", "None"), ("None", 2000, "revisit", "5")]
