import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidewell.llm import hilbert


def test_curve_visits_neighbours(spark):
    cells = spark.range(1 << 9).select(*((F.shiftright("id", 3 * i) % 8).alias(f"c{i}") for i in range(3)))
    rows = sorted(tuple(r) for r in hilbert.hilbert_index(cells, ["c0", "c1", "c2"], 3).select("hilbert", "c0", "c1", "c2").collect())
    assert [r[0] for r in rows] == list(range(1 << 9))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(rows, rows[1:], strict=False))


def test_query(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = defaultdict(list)
    rows = hilbert.op3_hilbert_shards(spark, sf).collect()
    for r in rows:
        raw = text[r["doc_id"]]
        assert r["size"] == len((raw or "").encode()) + 1 and r["text_crc32"] == (None if raw is None else zlib.crc32(raw.encode()))
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(text) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_cells_of_many_values_keep_order(spark):
    # as many distinct texts, and a third of the rows null or of one value
    n = 90_000
    value = F.when(F.col("id") < n // 9, None).when(F.col("id") < n // 3, "v05").otherwise(F.format_string("v%08d", F.col("id") * 7919 % n))
    rows = spark.range(n).select(value.alias("v"), F.col("id").alias("w")).repartition(5)
    got = [(r["v"] or "", r["__cell_0"], r["w"], r["__cell_1"]) for r in hilbert.quantise(rows, ["v", "w"]).collect()]
    assert len(got) == n and all(c == w * 16 // n for _, _, w, c in got)
    below, first = {}, None
    for at, v in enumerate(sorted(r[0] for r in got)):
        if v != first:
            below[v], first = at, v
    assert all(c == below[v] * 16 // n for v, c, _, _ in got)


def test_odd_rows(odd, none):
    rows, docs = odd
    out = hilbert.hilbert_shards(docs.withColumn("slot", F.lit("old")).drop("text"), "doc_id", ["source", "lang", "n_chars"], 3)
    sizes = [r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert hilbert.hilbert_shards(none.drop("text"), "doc_id", ["source"], 3).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
