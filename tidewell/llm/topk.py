"""Exact top-k inner products by block-at-a-time pruning.

Vectors are documents whose terms are their dimensions. Runs of documents form
blocks; a block keeps its forward index (its vectors as one matrix) and each
term's largest and smallest weight. For a query the summed best a block could
give, q+ * max + q- * min over its terms, bounds every score in it. A query takes
blocks in the order of their bounds, raises its k-th score after each, and stops
where the bounds fall below it.

Blocks lie in chunks of bounded size. Every query is first scored in the chunk
where it would stand itself, which is near it; with the k-th score found there
it then goes through the others, which give only scores that reach it.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read

#: Vectors in a document-range block, and queries that a task takes through a chunk at once.
BLOCK = 512
QUERY_BLOCK = 256
#: Bytes of the forward indexes of a chunk of blocks, which a task holds.
CHUNK_BYTES = 8 << 20
#: Queries that meet a chunk in one group at most, about.
MAX_GROUP = 20_000

#: Below every score: squared lengths stay under 2^62, and so do inner products.
NONE = -(2**63) + 1
MOST_NORM = 2.0**62

_ROWS = "chunk long, ids binary, weights binary, least binary, most binary, query_id long, q array<double>"
_FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; vectors null or with null or non-finite components go."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter("vec_id is not null and embedding is not null").filter(~bad).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; shorter ones end in zeros."""
    flat = column.values.to_numpy(zero_copy_only=False) if hasattr(column, "values") else column.flatten().to_numpy()
    offsets = column.offsets.to_numpy()
    flat = flat[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def _chunks(rows: DataFrame, dims: int, size: int, width: int, parts: int) -> DataFrame:
    """Cut (vec_id, v, asked) in the order of ``place`` into blocks of ``size`` vectors, ``width`` blocks a chunk.

    Rows that are ``asked`` are queries: they come out with the chunk they stand in, vectors in one row a block.
    """

    def pack(batches):
        import pyarrow as pa

        ids, mats, made = np.zeros(0, np.int64), np.zeros((0, dims)), 0
        base = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.float64())]
        names = [x.split()[0] for x in _ROWS.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def block(i, m):
            nonlocal made
            made += 1
            return [base + (made - 1) // width, i.tobytes(), m.tobytes(), m.min(axis=0).tobytes(), m.max(axis=0).tobytes(), None, None]

        for b in batches:
            asked = b.column(2).to_numpy(zero_copy_only=False)
            stand = np.flatnonzero(~asked)
            ids = np.concatenate([ids, b.column(0).to_numpy()[stand]])
            mats = np.concatenate([mats, _matrix(b.column(1), dims)[stand]])
            here = base + made // width
            full = len(ids) // size * size
            out = [block(ids[s : s + size], mats[s : s + size]) for s in range(0, full, size)]
            ids, mats = ids[full:], mats[full:]
            out += [[here, None, None, None, None, b.column(0)[int(i)].as_py(), b.column(1)[int(i)].as_py()] for i in np.flatnonzero(asked)]
            if out:
                yield batch(out)
        if len(ids):
            yield batch([block(ids, mats)])

    ordered = rows.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    return ordered.select("vec_id", "v", "asked").mapInArrow(pack, _ROWS)


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, equal ones by smaller id."""
    order = np.lexsort((ids, -scores, queries))
    asked = queries[order]
    place = np.arange(len(order)) - np.searchsorted(asked, asked)
    return order[place < k]


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers: summed in doubles while every sum fits 53 bits."""
    if np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * q.shape[1] < 2**53:
        return (q @ m.T).astype(np.int64)
    return q.astype(np.int64) @ m.astype(np.int64).T


def through_chunk(asked: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list, k: int):
    """(query, vec_id, score) of up to k vectors a query, ``asked`` (q, floor), from ``blocks`` (ids, weights, least, most).

    Block by block in the order of each query's bounds, until they fall below its
    k-th score so far or ``floor``. Scores below that are left out. Bounds are sums
    of doubles and are raised by more than their rounding.
    """
    high, low = np.array([b[3] for b in blocks]), np.array([b[2] for b in blocks])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bound += np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T * (q.shape[1] * 2.0**-50)
    order = np.argsort(-bound, axis=1, kind="stable")
    floor, best = floor.astype(np.int64), np.full((len(q), k), NONE)
    found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for turn in range(len(blocks)):
        at = order[:, turn]
        live = bound[np.arange(len(q)), at] >= floor
        if not live.any():
            break
        for block in np.unique(at[live]):
            rows = np.flatnonzero(live & (at == block))
            ids, m = blocks[block][:2]
            scores = _products(q[rows], m)
            scores[asked[rows, None] == ids] = NONE
            r, c = np.nonzero((scores >= floor[rows, None]) & (scores > NONE))
            for to, x in zip(found, (rows[r], ids[c], scores[r, c]), strict=True):
                to.append(x)
            best[rows] = -np.partition(-np.concatenate([best[rows], scores], axis=1), k - 1, axis=1)[:, :k]
            floor[rows] = np.maximum(floor[rows], best[rows].min(axis=1))
    query, ids, scores = map(np.concatenate, found)
    keep = np.flatnonzero(scores >= floor[query])
    keep = keep[_best(query[keep], ids[keep], scores[keep], k)]
    return asked[query[keep]], ids[keep], scores[keep]


def _score(queries: DataFrame, blocks: DataFrame, dims: int, k: int, salts: int) -> DataFrame:
    """(query_id, vec_id, score) of ``queries`` (chunk, query_id, q, floor) in the blocks of their chunks.

    A chunk is copied to ``salts`` groups, each with a share of the queries that reach it.
    """

    def work(left, right):
        import pyarrow as pa

        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        if right.num_rows and left.num_rows:
            columns = [right.column(c).to_pylist() for c in ("ids", "weights", "least", "most")]
            blocks = [(np.frombuffer(i, np.int64), np.frombuffer(w).reshape(-1, dims), np.frombuffer(a), np.frombuffer(b)) for i, w, a, b in zip(*columns, strict=True)]
            asked, floor = left.column("query_id").to_numpy(), left.column("floor").to_numpy()
            q = _matrix(left.column("q").combine_chunks(), dims)
            for s in range(0, len(asked), QUERY_BLOCK):
                e = s + QUERY_BLOCK
                for to, x in zip(found, through_chunk(asked[s:e], q[s:e], floor[s:e], blocks, k), strict=True):
                    to.append(x)
        return pa.table({n: np.concatenate(x).astype(np.int64) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    salted = queries.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.groupBy("chunk", "salt").cogroup(copies.groupBy("chunk", "salt")).applyInArrow(work, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES, group: int = MAX_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` (vec_id, v) for each of ``queries``, whole and exact.

    A query never meets a row with its own id; equal scores go to smaller ids;
    fewer rows than k give them all. Vectors of unequal length are compared as if
    the shorter ended in zeros. Of rows of ``queries`` with equal ids one asks; a
    repeated vector is a row of its own. No queries or vectors give no rows.
    ``block``, ``chunk_bytes`` and ``group`` bound what a task holds and change no result.
    Scores are exact 64-bit integers; vectors whose inner products may pass these,
    by their lengths, are refused.
    """
    spark = queries.sparkSession
    queries = cut(queries.groupBy("vec_id").agg(F.max("v").alias("v")))
    vectors = cut(vectors.select("vec_id", "v"))
    square = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    shape = vectors.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n"), square).first()
    asked = queries.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n"), square).first()
    if (longest := float(np.sqrt((shape["norm"] or 0.0) * (asked["norm"] or 0.0)))) >= MOST_NORM:
        raise ValueError(f"scores may pass 64 bits: lengths multiply to {longest}")
    dims = max(shape["d"] or 1, asked["d"] or 1, 1)
    width = max(1, chunk_bytes // (8 * dims * block))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(slots, -(-shape["n"] // (width * block))))
    salts = max(1, -(-asked["n"] // group), min(-(-asked["n"] // QUERY_BLOCK), -(-slots // parts)))
    # neighbours in blocks make tight bounds: order by the signs of the leading components
    signs = [F.coalesce(F.when(F.get("v", F.lit(i)) > 0, F.lit(1 << (15 - i))), F.lit(0)) for i in range(min(dims, 16))]
    both = vectors.withColumn("asked", F.lit(False)).union(queries.withColumn("asked", F.lit(True))).withColumn("place", sum(signs[1:], signs[0]))
    rows = cut(_chunks(both, dims, block, width, parts))
    blocks = rows.filter("query_id is null").select("chunk", "ids", "weights", "least", "most")
    wide = rows.filter("query_id is not null").select(F.col("chunk").alias("home"), "query_id", "q")
    lowest = F.lit(NONE)
    near = cut(_score(wide.select(F.col("home").alias("chunk"), "query_id", "q", lowest.alias("floor")), blocks, dims, k, salts))
    floor = _top(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
    chunks = blocks.select("chunk").distinct()
    # a stated query set against all blocks: each query is dealt to every other chunk, by key and not as pairs of rows
    all_chunks = F.broadcast(chunks.agg(F.collect_list("chunk").alias("chunks")))
    others = wide.join(floor, "query_id", "left").crossJoin(all_chunks)
    others = others.select(F.explode(F.filter("chunks", lambda c: c != F.col("home"))).alias("chunk"), "query_id", "q", F.coalesce("known", lowest).alias("floor"))
    return _top(near.union(_score(others, blocks, dims, k, salts)), k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
