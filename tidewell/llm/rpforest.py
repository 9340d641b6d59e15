"""Near duplicates of embeddings by a forest of random-projection trees with spill.

Every tree splits space again and again at a random quantile of a random
projection; vectors within a margin of the split go down both sides, so close
pairs seldom part, and those that do meet in another tree. Vectors are compared
within leaves only, each pair counted in the first leaf that both share, and
links are joined to components. Equal vectors are one row until the end.

Trees are fitted on ``SAMPLE`` vectors at most. Where these are too few to split a
leaf down to its size, it goes on by hyperplanes at medians of what the leaf has
of the sample. A leaf with more than ``MOST`` rows is compared in tiles, whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, cut, join_salted, read

SIMILARITY = 0.95
TREES = 6
#: Vectors that fit the trees, drawn by a hash of their ids; every vector is indexed.
SAMPLE = 16_384
#: Rows of a leaf, about, and of a side of the largest tile.
LEAF = 512
MOST = 2048
#: Sample vectors that a fitted split needs.
LEAST_SPLIT = 32
#: Rows of one key that one task joins, about.
HOT = 20_000


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow or underflow on the way."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as rows of doubles; shorter lists end in zeros."""
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    sizes = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(sizes), dims))
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Tree:
    """A fitted tree: node i splits on the direction of its depth at cuts[i]; down[i] has its children, or -1 for a leaf.

    Leaves have ``more`` further hyperplanes, at deeper[leaf], that are the same for all of the leaf.
    """

    def __init__(self, sample: np.ndarray, rows: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        dims, scale = sample.shape[1], rows / max(1, len(sample))
        depth = max(1, int(np.ceil(np.log2(max(2.0, rows / leaf)))) + 4)
        directions = rng.standard_normal((depth, dims))
        self.directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
        place = sample @ self.directions.T
        self.cuts, self.down, self.more, self.deeper = [0.0], [(-1, -1)], [0], [np.zeros(0)]
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, mine, level = todo.pop()
            if level == depth or len(mine) * scale <= leaf:
                continue
            if len(mine) < LEAST_SPLIT:
                self.more[node] = min(depth - level, int(np.ceil(np.log2(max(1.0, len(mine) * scale / leaf)))))
                self.deeper[node] = np.median(place[mine], axis=0) if len(mine) else np.zeros(depth)
                continue
            split = np.quantile(place[mine, level], rng.uniform(0.4, 0.6))
            left = place[mine, level] <= split
            if left.all() or not left.any():  # this direction tells these apart no further
                if level + 1 < depth:
                    child = self._grow()
                    self.down[node] = (child, child)
                    todo.append((child, mine, level + 1))
                continue
            self.cuts[node] = float(split)
            self.down[node] = (self._grow(), self._grow())
            todo += [(self.down[node][0], mine[left], level + 1), (self.down[node][1], mine[~left], level + 1)]
        self.cuts, self.down, self.more = np.array(self.cuts), np.array(self.down), np.array(self.more)

    def _grow(self) -> int:
        for to, x in ((self.cuts, 0.0), (self.down, (-1, -1)), (self.more, 0), (self.deeper, np.zeros(0))):
            to.append(x)
        return len(self.cuts) - 1

    def leaves(self, m: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row of ``m`` reaches; those within ``margin`` of a split go down both sides."""
        place = m @ self.directions.T
        rows, nodes, done = np.arange(len(m)), np.zeros(len(m), np.int64), []
        for level in range(place.shape[1]):
            ended = self.down[nodes, 0] < 0
            done.append((rows[ended], nodes[ended], np.full(ended.sum(), level)))
            rows, nodes = rows[~ended], nodes[~ended]
            if not len(rows):
                break
            off = place[rows, level] - self.cuts[nodes]
            left, right = off <= margin, off > -margin
            both = self.down[nodes, 0] == self.down[nodes, 1]
            right &= ~both
            left |= both
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([self.down[nodes[left], 0], self.down[nodes[right], 1]])
        done.append((rows, nodes, np.full(len(rows), place.shape[1])))
        rows, nodes, levels = (np.concatenate(x) for x in zip(*done, strict=True))
        codes = np.zeros(len(rows), np.int64)
        for step in range(int(self.more.max(initial=0))):
            on = np.flatnonzero(self.more[nodes] > step)
            cuts = np.array([self.deeper[k][level + step] for k, level in zip(nodes[on], levels[on], strict=True)])
            off = place[rows[on], levels[on] + step] - cuts
            right, twice = off > -margin, on[np.abs(off) <= margin]
            codes[on] |= np.int64(1) << np.int64(step)
            codes[on[~right]] &= ~(np.int64(1) << np.int64(step))
            rows, nodes, levels = (np.concatenate([x, x[twice]]) for x in (rows, nodes, levels))
            codes = np.concatenate([codes, codes[twice] & ~(np.int64(1) << np.int64(step))])
        return rows, (nodes << 32) | codes


def fit(reps: DataFrame, rows: int, dims: int, trees: int = TREES, leaf: int = LEAF) -> list[Tree]:
    """``trees`` trees from a sample of at most SAMPLE vectors, which alone reaches the driver."""
    drawn = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    sample = unit_rows(matrix(drawn.column("v"), dims)) if drawn.num_rows else np.zeros((0, dims))
    return [Tree(sample, rows, leaf, seed) for seed in range(trees)]


def routed(reps: DataFrame, forest: list[Tree], dims: int, margin: float) -> DataFrame:
    """(leaf, rep, copies, v, leaves): ``reps`` once for each leaf that they reach, with all of these."""

    def route(batches):
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                m = unit_rows(matrix(part.column("v"), dims))
                found = [(r, (np.int64(t) << np.int64(56)) | leaf) for t, tree in enumerate(forest) for r, leaf in [tree.leaves(m, margin)]]
                row, leaf = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(m)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf))
                table = pa.Table.from_batches([part]).append_column("leaves", lists).take(pa.array(row))
                yield from table.add_column(0, "leaf", pa.array(leaf)).combine_chunks().to_batches()

    kind = reps.schema["v"].dataType.simpleString()
    return reps.select("rep", "copies", "v").mapInArrow(route, f"leaf long, rep long, copies long, v {kind}, leaves array<long>")


def _share_earlier(leaves: list[np.ndarray], here: int) -> np.ndarray:
    """Which pairs of rows share a leaf before ``here``, one matrix product for each thousand leaves."""
    earlier = [x[x < here] for x in leaves]
    known, column = np.unique(np.concatenate(earlier), return_inverse=True)
    row = np.repeat(np.arange(len(leaves)), [len(x) for x in earlier])
    shared = np.zeros((len(leaves), len(leaves)), bool)
    for s in range(0, len(known), 1024):
        on = (column >= s) & (column < s + 1024)
        marks = np.zeros((len(leaves), min(1024, len(known) - s)), np.float32)
        marks[row[on], column[on] - s] = 1
        shared |= (marks @ marks.T) > 0
    return shared


def _roots(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric matrix of links reaches."""
    a, b = np.nonzero(links)
    root = np.arange(len(links))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, m: np.ndarray, leaves: list[np.ndarray], here: int, least: float):
    """(id, links, root) of the rows of a tile that link: links that no earlier leaf counts, weighted by copies, and the smallest id linked here.

    ``side`` is 0 or 1 for the two slices of a tile, all 0 in one of a slice alone.
    Only rows that link at all meet the check of earlier leaves.
    """
    order = np.argsort(ids, kind="stable")
    ids, copies, side, m = ids[order], copies[order], side[order], m[order]
    near = (m @ m.T) >= least
    near &= ids[:, None] != ids[None, :]
    if side.any():
        near &= side[:, None] != side[None, :]
    met = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(met, met)]
    fresh = near & ~_share_earlier([leaves[order[k]] for k in met], here) if len(met) else near
    return ids[met], fresh @ copies[met], ids[met][_roots(near)]


def links(placed: DataFrame, dims: int, least: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(rep, n, root): rows that link within leaves of ``placed`` (routed, written), one a leaf or tile."""

    def tile(table):
        import pyarrow as pa

        here = table.column("leaf")[0].as_py()
        leaves = table.column("leaves").combine_chunks()
        ends = leaves.offsets.to_numpy()
        flat = leaves.values.to_numpy()
        side = (table.column("slice").to_numpy() != table.column("i")[0].as_py()).astype(np.int8)
        found = compare(
            table.column("rep").to_numpy(), table.column("copies").to_numpy(), side, unit_rows(matrix(table.column("v"), dims)), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], here, least
        )
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("rep", "n", "root"), found, strict=True)})

    large = cut(placed.groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") > most))
    slices = F.coalesce(F.ceil(F.col("rows") / most), F.lit(1)).cast("int")
    dealt = placed.join(large, "leaf", "left").withColumn("slice", F.pmod(F.xxhash64("rep"), slices).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda s: F.struct(F.least(s, "slice").alias("i"), F.greatest(s, "slice").alias("j")))
    dealt = dealt.withColumn("tile", F.explode(pairs)).select("leaf", "tile.i", "tile.j", "slice", "rep", "copies", "v", "leaves")
    return dealt.groupBy("leaf", "i", "j").applyInArrow(tile, "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, least: float = SIMILARITY, trees: int = TREES, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Pairs of cosine ``least`` or more that share a leaf link; no others do. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing, and so do rows without vec_id, whose component is null and which stay.
    Shorter vectors are met as if they ended in zeros. Repeated rows link with each
    other; rows of one vec_id with different vectors are one node, which links where
    any of them does. No rows give no rows.
    """
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = F.when(sound & F.col("vec_id").isNotNull(), F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    rows = cut(vectors.select("vec_id", v.alias("v")).select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2")))
    reps = cut(rows.filter("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    shape = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    dims = max(1, shape["d"] or 1)
    margin = float(np.sqrt(2 * (1 - least)) / np.sqrt(dims) / 4)
    forest = fit(reps, shape["n"], dims, trees, leaf)
    found = cut(links(cut(routed(reps, forest, dims, margin)), dims, least, most))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = connected_components(found.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    known = cut(known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = join_salted(rows.filter("v is not null").select("vec_id", "k1", "k2"), known, ["k1", "k2"], HOT).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {SIMILARITY}),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON a = node
"""
