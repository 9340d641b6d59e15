"""Hard negatives by one-dimensional distance keys.

Inner products become distances: a vector x gets one more component,
sqrt(M^2 - |x|^2) with M the greatest length, and an anchor a zero there, so that
|q'|^2 + M^2 - 2 q.x is their squared distance. Every vector is stored under its
nearest pivot, sorted by (pivot, distance to it), in chunks of one pivot. By the
triangle inequality a vector at distance s from an anchor has a key within s of
the anchor's own distance to that pivot: an interval scan of width s around that
misses none of the annulus. A search first scans the chunk around the anchor's own
key; the k-th score found there bounds how wide the scan of the other chunks must
be, and within a task it goes outwards chunk by chunk, until the distance bound of
what remains certifies the k best.

Files of anchors say little of what their annuli become in memory, so tables with a
row an anchor or more are joined by shuffles; the headings of chunks are broadcast.

Scores are exact integers; distances only say what needs no look and are widened
by more than their rounding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read
from tidewell.llm.rpforest import matrix

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least so many hundredths of its positive.
LOWEST = 80
#: Vectors of which pivots are drawn, by a hash of their ids, and pivots at most.
SAMPLE = 4096
PIVOTS = 64
#: Rows that a pivot should have at least, and rows of a chunk, which a task holds.
PER_PIVOT = 4096
CHUNK = 8192
#: Rings of keys of a pivot, by which intervals meet chunks.
RINGS = 32
#: Anchors that a task takes through a chunk at once, and that one group holds, about.
BATCH = 256
GROUP = 20_000
#: Relative widening of distances, far more than their rounding.
SLACK = 1e-6
#: Scores must fit 64-bit integers.
MOST_NORM = 2.0**62

_CHUNKS = "chunk long, pivot int, low double, high double, ids binary, labels binary, weights binary"


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component; rows without vec_id, label or a finite whole vector go."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


class Space:
    """Pivots in the augmented space and the distances there: what tasks need to know of the whole table."""

    def __init__(self, sample: np.ndarray, norm: float, pivots: int, rings: int):
        self.norm, self.rings, self.dims = norm, rings, sample.shape[1]
        whole = np.hstack([sample, np.sqrt(np.maximum(0, norm - (sample * sample).sum(axis=1)))[:, None]])
        chosen = [0] if len(whole) else []
        far = np.full(len(whole), np.inf)
        while len(chosen) < min(pivots, len(whole)):  # each next pivot is the sample's farthest from all so far
            far = np.minimum(far, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(far.argmax()))
        self.pivots = whole[chosen] if chosen else np.zeros((1, self.dims + 1))
        self.squares = (self.pivots**2).sum(axis=1)
        self.width = max(1e-9, 2.0 * np.sqrt(norm + self.squares.max()) / rings)
        self.slack = SLACK * np.sqrt(norm + self.squares.max()) + 1e-9

    def distances(self, m: np.ndarray, anchors: bool) -> np.ndarray:
        """From each row to each pivot; ``anchors`` have nothing in the added component."""
        own = (m * m).sum(axis=1)
        last = 0.0 if anchors else np.sqrt(np.maximum(0, self.norm - own))[:, None] * self.pivots[None, :, -1]
        mine = own[:, None] if anchors else max(self.norm, 0.0)
        return np.sqrt(np.maximum(0, mine + self.squares - 2 * (m @ self.pivots[:, :-1].T + last)))

    def reach(self, m: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector has ``score`` with the anchor in the same row of ``m``."""
        return np.sqrt(np.maximum(0, (m * m).sum(axis=1) + self.norm - 2 * score))


def products(q: np.ndarray, m: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products as 64-bit integers: no sum on the way passes ``norm``."""
    if norm < 2.0**53:
        return (q @ m.T).astype(np.int64)
    return q.astype(np.int64) @ m.astype(np.int64).T


class Index:
    """``vectors`` (vec_id, label, v) in chunks of one pivot, sorted by distance, written once.

    ``max_chunk`` bounds what a task holds. Squared lengths of 2^62 and more, with
    which scores may pass 64 bits, are refused.
    """

    def __init__(self, vectors: DataFrame, max_chunk: int = CHUNK, pivots: int = PIVOTS, per_pivot: int = PER_PIVOT, rings: int = RINGS):
        spark = vectors.sparkSession
        rows = cut(vectors.select("vec_id", "label", "v"))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(square).alias("norm")).first()
        self.n, self.dims, norm = shape["n"], max(1, shape["d"] or 1), float(shape["norm"] or 0.0)
        if norm >= MOST_NORM:
            raise ValueError(f"scores may pass 64 bits: a squared length is {norm}")
        drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        sample = matrix(drawn.column("v"), self.dims) if drawn.num_rows else np.zeros((0, self.dims))
        self.space = Space(sample, norm, max(1, min(pivots, self.n // per_pivot)), rings)
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n // max_chunk)))
        keyed = self._keyed(rows).repartitionByRange(parts, "pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id")
        self.chunks = cut(self._packed(keyed, max_chunk))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        space, dims = self.space, self.dims

        def key(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    far = space.distances(matrix(b.column(2), dims), False)
                    at = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(far[np.arange(len(at)), at])], [*b.schema.names, "pivot", "key"])

        return rows.mapInArrow(key, "vec_id long, label long, v array<double>, pivot int, key double")

    def _packed(self, keyed: DataFrame, most: int) -> DataFrame:
        dims = self.dims

        def pack(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            made, base = 0, TaskContext.get().partitionId() << 32
            held = None

            def chunk(ids, labels, pivots, keys, m):
                nonlocal made
                made += 1
                row = [base + made - 1, int(pivots[0]), float(keys[0]), float(keys[-1]), ids.tobytes(), labels.tobytes(), m.tobytes()]
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 3), strict=True)], [c.split()[0] for c in _CHUNKS.split(", ")])

            for b in batches:
                new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(), matrix(b.column(2), dims)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                while len(held[0]):
                    end = int(np.searchsorted(held[2], held[2][0], "right"))
                    if end < most and end == len(held[0]):
                        break
                    end = min(end, most)
                    yield chunk(*(x[:end] for x in held))
                    held = [x[end:] for x in held]
            if held is not None and len(held[0]):
                yield chunk(*held)

        return keyed.select("vec_id", "label", "v", "pivot", "key").mapInArrow(pack, _CHUNKS)

    def _intervals(self, asked: DataFrame, home: bool) -> DataFrame:
        """(query_id, chunk) of the chunks that an anchor's annulus may meet, by rings of keys; vectors stay where they are.

        ``home``: one chunk at most, that whose keys are next to the anchor's own at its nearest pivot.
        """
        space, dims = self.space, self.dims

        def spread(batches):
            import pyarrow as pa

            for b in batches:
                m = matrix(b.column(1), dims)
                far = space.distances(m, True)
                out = space.reach(m, b.column(2).to_numpy()) + space.slack
                row, pivot = np.repeat(np.arange(len(m)), far.shape[1]), np.tile(np.arange(far.shape[1]), len(m))
                if home:
                    row, pivot, out = np.arange(len(m)), far.argmin(axis=1), np.zeros(len(m))
                low, high = far[row, pivot] - out[row], far[row, pivot] + out[row]
                ids = b.column(0).take(pa.array(row))
                ring = [np.clip(x / space.width, 0, space.rings - 1).astype(np.int32) for x in (low, high)]
                arrays = [ids, pa.array(pivot, pa.int32()), pa.array(far[row, pivot]), pa.array(low), pa.array(high), *map(pa.array, ring)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "pivot", "at", "from", "to", "r0", "r1"])

        spans = asked.select("query_id", "v", "floor").mapInArrow(spread, "query_id long, pivot int, at double, from double, to double, r0 int, r1 int")
        ring = lambda c: F.least(F.floor(F.col(c) / space.width), F.lit(space.rings - 1)).cast("int")
        chunks = self.chunks.select("chunk", F.col("pivot").alias("own"), "low", "high", ring("low").alias("c0"), ring("high").alias("c1"))
        spans = spans.withColumn("ring", F.explode(F.sequence("r0", "r1")))
        # what is broadcast are the headings of chunks, a row for thousands of vectors, never the anchors' rings
        chunks = F.broadcast(chunks.withColumn("ring2", F.explode(F.sequence("c0", "c1"))))
        met = spans.join(chunks, (F.col("pivot") == F.col("own")) & (F.col("ring") == F.col("ring2")))
        if home:
            gap = F.greatest(F.lit(0.0), F.col("low") - F.col("at"), F.col("at") - F.col("high"))
            return met.groupBy("query_id").agg(F.min_by("chunk", F.struct(gap, "chunk")).alias("chunk"))
        once = (F.col("ring") == F.greatest("r0", "c0")) & (F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low"))
        return met.filter(once).select("query_id", F.col("chunk").alias("chunk"))

    def _scan(self, asked: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        """(query_id, window, vec_id, score): the k best of each window in the chunks that ``pairs`` names."""
        space, dims, norm = self.space, self.dims, self.space.norm

        def work(left, right):
            import pyarrow as pa

            found = [[np.zeros(0, np.int64)] for _ in range(4)]
            if left.num_rows and right.num_rows:
                pivot, low, high = (right.column(c)[0].as_py() for c in ("pivot", "low", "high"))
                ids, labels = (np.frombuffer(right.column(c)[0].as_py(), np.int64) for c in ("ids", "labels"))
                m = np.frombuffer(right.column("weights")[0].as_py()).reshape(-1, dims)
                key = space.distances(m, False)[:, pivot]
                for s in range(0, left.num_rows, BATCH):
                    part = left.slice(s, BATCH)
                    for to, x in zip(found, through_chunk(part, matrix(part.column("v"), dims), space, pivot, key, ids, labels, m, norm, k, same), strict=True):
                        to.append(x)
            return pa.table({n: np.concatenate(x).astype(np.int64) for n, x in zip(("query_id", "window", "vec_id", "score"), found, strict=True)})

        count = asked.count()
        salts = max(1, -(-count // GROUP))
        salt = F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int")
        dealt = pairs.join(asked.hint("merge"), "query_id").withColumn("salt", salt)
        chunks = self.chunks.select(*[F.col(c).alias(c) for c in self.chunks.columns]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return dealt.groupBy("chunk", "salt").cogroup(chunks.groupBy("chunk", "salt")).applyInArrow(work, "query_id long, window long, vec_id long, score long")

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(query_id, window, rank, vec_id, score): the k highest-scoring vectors of each window of each anchor.

        ``asked`` has query_id (unique), label, v and windows, an array of (least,
        most): a window takes scores between these, both included, null meaning any.
        ``same``: only vectors of the anchor's label, not its own row, else only those
        of others. Ties go to smaller ids.
        """
        # what any window can still need: the lowest score that counts
        anything = F.lit(-float(MOST_NORM))
        lowest = F.array_min(F.transform("windows", lambda w: F.coalesce(w["least"].cast("double"), anything)))
        asked = cut(asked.select("query_id", "label", "v", "windows", F.greatest(lowest, anything).alias("floor")))
        near = cut(_best(self._scan(asked, self._intervals(asked, True), k, same), k))
        kth = near.filter(F.col("rank") == k).groupBy("query_id", "window").agg(F.max("score").alias("kth"))
        # each window's own k-th score so far, and of these the lowest, which the scan must reach
        raised = kth.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("known"))
        place = F.transform("windows", lambda w, i: F.struct(F.greatest(w["least"], F.element_at("known", i.cast("long"))).alias("least"), w["most"].alias("most")))
        home = self._intervals(asked, True).select("query_id", F.col("chunk").alias("home"))
        again = asked.join(raised.hint("merge"), "query_id", "left").withColumn("windows", place).drop("known", "floor")
        floor = F.array_min(F.transform("windows", lambda w: F.coalesce(w["least"].cast("double"), anything)))
        again = cut(again.withColumn("floor", floor))
        rest = self._intervals(again, False).join(home.hint("merge"), "query_id", "left").filter("home is null or home != chunk").drop("home")
        return _best(near.drop("rank").union(self._scan(again, rest, k, same)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _share(score: Column, hundredths: int) -> Column:
    """The least integer of at least so many hundredths of a score that isn't negative, without passing 64 bits."""
    whole = lambda c: F.call_function("div", c, F.lit(100).cast("long"))
    return whole(score) * hundredths + whole(score % 100 * hundredths + 99)


def through_chunk(asked, q: np.ndarray, space: Space, pivot: int, key: np.ndarray, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, norm: float, k: int, same: bool, step: int = 512):
    """(query, window, vec_id, score) of up to k vectors of one chunk for each window of ``asked``.

    Runs of ``step`` keys are taken outwards from each anchor's own key. A run is
    left out where its annulus (key - at, key + at) lies wholly within the distance
    of a window's highest score or beyond that of its lowest, or of its k-th so far;
    when all that remain are beyond, the k are certified.
    """
    query, own = asked.column("query_id").to_numpy(), asked.column("label").to_numpy()
    windows = asked.column("windows").to_pylist()
    row = np.repeat(np.arange(len(query)), [len(w) for w in windows])
    number = np.concatenate([np.arange(len(w)) for w in windows]) if len(row) else row
    lowest, highest = -(2**63), 2**63 - 1
    least = np.array([lowest if x["least"] is None else x["least"] for w in windows for x in w], np.int64)
    most = np.array([highest if x["most"] is None else x["most"] for w in windows for x in w], np.int64)
    at = space.distances(q, True)[:, pivot]
    runs = [(s, min(s + step, len(ids))) for s in range(0, len(ids), step)]
    low, high = np.array([key[s:e].min() for s, e in runs]), np.array([key[s:e].max() for s, e in runs])
    near = np.maximum(0, np.maximum(low[None, :] - at[:, None], at[:, None] - high[None, :]))
    order = np.argsort(near, axis=1, kind="stable")
    inner = np.where(most == highest, 0, space.reach(q[row], most.astype(np.float64))) - space.slack
    outer = np.where(least == lowest, np.inf, space.reach(q[row], least.astype(np.float64))) + space.slack
    kept: list[list[tuple[int, int]]] = [[] for _ in row]
    for turn in range(len(runs)):
        run = order[:, turn]
        live = near[row, run[row]] <= outer
        if not live.any():
            break  # what remains of every anchor is farther off still
        live &= at[row] + high[run[row]] >= inner
        for r in np.unique(run[row[live]]):
            s, e = runs[r]
            on = np.flatnonzero(live & (run[row] == r))
            anchors, which = np.unique(row[on], return_inverse=True)
            scores = products(q[anchors], m[s:e], norm)
            allowed = (labels[None, s:e] == own[anchors, None]) & (ids[None, s:e] != query[anchors, None]) if same else labels[None, s:e] != own[anchors, None]
            for w, a in zip(on, which, strict=True):
                here = np.flatnonzero(allowed[a] & (scores[a] >= least[w]) & (scores[a] <= most[w]))
                if not len(here):
                    continue
                if len(here) > k:
                    value = scores[a][here]
                    here = here[value >= np.partition(value, len(value) - k)[len(value) - k]]
                kept[w] += [(-int(scores[a, c]), int(ids[s + c])) for c in here]
                kept[w].sort()
                del kept[w][k:]
                if len(kept[w]) == k:
                    least[w] = max(least[w], -kept[w][-1][0])
                    outer[w] = space.reach(q[row[w]][None], np.array([float(least[w])]))[0] + space.slack
    rows = [(query[row[w]], number[w], d, -s) for w in range(len(row)) for s, d in kept[w]]
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def mine(anchors: DataFrame, vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, **bounds) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), whole and exact.

    ``vectors`` as ``prepared`` gives them, ``anchors`` rows of them. An anchor's
    positives are its first ``positives`` other rows of its label by score, ties by
    smaller id. For each, the first ``negatives`` rows of other labels count whose
    score is at most the positive's and at least ``lowest`` hundredths of it; a
    negative positive score leaves none. An anchor that stands twice asks once; a
    repeated row counts as often as it stands, as a positive with ranks of its own.
    Shorter vectors are met as if they ended in zeros. No rows give no rows.
    """
    index = Index(vectors, **bounds)
    asked = cut(anchors.groupBy(F.col("vec_id").alias("query_id")).agg(F.max(F.struct("label", "v")).alias("a")).select("query_id", "a.label", "a.v"))
    window = lambda least, most: F.struct(least.cast("long").alias("least"), most.cast("long").alias("most"))
    whole = asked.withColumn("windows", F.array(window(F.lit(None), F.lit(None))))
    found = cut(index.search(whole, positives, True).select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank").filter("positive_score >= 0"))
    listed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    ready = asked.join(listed.hint("merge"), "query_id").withColumn("windows", F.transform("p", lambda p: window(_share(p["positive_score"], lowest), p["positive_score"])))
    met = index.search(ready.select("query_id", "label", "v", "windows"), negatives, False)
    place = listed.select("query_id", F.posexplode("p").alias("window", "p"))
    return met.join(place.withColumn("window", F.col("window").cast("long")).hint("merge"), ["query_id", "window"]).select(
        F.col("query_id").alias("anchor_id"), "p.positive_id", "rank", F.col("vec_id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows.filter("vec_id % 100 = 0"), rows)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
