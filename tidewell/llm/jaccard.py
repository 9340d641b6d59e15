"""Exact Jaccard join of shingle sets over count vectors.

Documents are sets of hashed five-word shingles. Two sets with 100 * |A & B| >=
80 * |A | B| differ in at most min(|A|, |B|) / 4 shingles, which gives the three
steps of the join:

1. Sets that are equal fall into one class; one document stands for it.
2. Shingles are hashed into groups. A difference of d shingles touches at most d
   groups, so of each set's first |A| / 4 + 1 non-empty groups one is the same in
   both. Equal groups deal representatives out to buckets, whatever the number of
   documents. (Sets of up to 64 shingles use groups of one shingle.)
3. Within buckets the group counts are points. An R-tree packed over them bounds
   the overlap of any two points or boxes by the sum of coordinate minima, which
   leaves few pairs; these are verified on the whole sets.

Of most buckets the tree is a single leaf, whose pairs are bounded at once; each
member gives one link to an earlier one, and a bucket with no other pair is done.
A larger one is searched around one member, which links the others to it. Members
already known to be connected need no further links, so a group of thousands of
near copies takes a few links a member and not all pairs; the trees of buckets
that are still apart are then joined with themselves.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import (
    binary_parts,
    connected_components,
    cut,
    lowered,
    mix,
    odd_constants,
    read,
    uncut,
    utf8_batches,
    word_hashes,
    word_spans,
)

WORDS = 5
#: Largest set of the class whose groups are single shingles; further classes double.
SMALL = 64
#: Ids of candidates up to this number are sent to all executors to pick their texts; beyond it a join shuffles texts.
MAX_IDS = 500_000
#: Ratio of sizes that a band spans; sets that link differ by a ratio of 1.25 at most.
BAND = 1.26
#: Points in a leaf of the R-tree.
LEAF = 32
#: Members of a bucket, and bytes of their points, that one task holds; larger buckets are dealt out in slices.
BUCKET = 20_000
SLICE_BYTES = 64 << 20
#: Rounds that search around one member of each bucket, before its tree is joined with itself.
STAR_ROUNDS = 2
#: Buckets with the same members draw up to so many different centres in a round.
CENTRES = 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIXERS = odd_constants(64, 71)


def shingle_sets(array):
    """Yield (row, sorted distinct shingle hashes) for each text of an Arrow string array."""
    weights = odd_constants(WORDS, 37)
    for first, data, offsets in utf8_batches(array):
        starts, ends, row = word_spans(data, offsets, _SPACE)
        with np.errstate(over="ignore"):
            words = word_hashes(lowered(data), starts, ends)
            n = len(words)
            runs = np.zeros(max(n - WORDS + 1, 0), np.uint64)
            for i in range(WORDS):
                runs += words[i : i + len(runs)] * weights[i]
            runs = mix(runs)
            at = np.searchsorted(row, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                s, e = at[r], at[r + 1]
                if e - s >= WORDS:
                    yield first + r, np.unique(runs[s : e - WORDS + 1])
                elif e > s:
                    whole = mix((words[s:e] * weights[: e - s]).sum(keepdims=True) + np.uint64(e - s))
                    yield first + r, whole
                else:
                    yield first + r, np.zeros(0, np.uint64)


def _class(n: int) -> int:
    """0 for sets of up to SMALL shingles, then 1, 2, ... for each doubling."""
    return max(0, (n - 1).bit_length() - (SMALL - 1).bit_length())


def signatures(u: np.ndarray) -> np.ndarray:
    """Hashes of the groups that a sorted set shares with any set it may link with, one of them at least."""
    n, out = len(u), []
    most = n // 4
    if most == 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        own = _class(n)
        for c in (own, own + 1) if n + most > SMALL << own else (own,):
            salt = _MIXERS[c]
            if c == 0:
                out.append(mix(u[: most + 1] ^ salt))
                continue
            groups = (SMALL << c) * 2 // 5
            g = ((mix(u * salt) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            g = g[order]
            begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[: most + 2]
            content = np.add.reduceat(mix(u[order] ^ salt), begin)[: most + 1]
            out.append(mix(content + g[begin][: most + 1].astype(np.uint64) * _MIXERS[32] + salt))
    return np.concatenate(out).view(np.int64)


def count_vector(u: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash group in four bits each: 15 stands for 15 and more.

    Groups hold two shingles on average at most in small sets and eight in large
    ones, whose bounds vary less: a vector goes to every bucket of its set, and
    large sets have most. Larger classes have as many groups or more, each a
    refinement. What counts above 15 leave out is the set's excess, which bounds
    add: two sets share no more of it than the smaller excess.
    """
    dims = 2 * _packed(_class(len(u)))
    counts = np.bincount((mix(u ^ _MIXERS[63]) % np.uint64(dims)).astype(np.int64), minlength=dims)
    two = np.minimum(counts, 15).astype(np.uint8).reshape(-1, 2)
    return (two[:, 0] | two[:, 1] << 4).tobytes()


def _packed(c: int) -> int:
    """Bytes of the count vectors of class ``c``."""
    return min(16 << c, max(64, 4 << c))


def _packed_sql(n: str) -> str:
    """The same, as SQL, of sets of ``n`` shingles."""
    c = f"greatest(0, length(bin({n} - 1)) - {(SMALL - 1).bit_length()})"
    return f"least(shiftleft(16L, {c}), greatest(64L, shiftleft(4L, {c})))"


#: The two counts of a packed byte, and their sum.
_HALVES = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 4], np.uint8)) & np.uint8(15)
_SUMS = _HALVES.sum(axis=1).astype(np.uint8)


def folded(counts: np.ndarray, dims: int) -> np.ndarray:
    """Rows of counts over a multiple of ``dims`` groups, summed to ``dims``."""
    return counts.reshape(*counts.shape[:-1], -1, dims).sum(axis=-2, dtype=np.uint16)


class Points:
    """Rows of packed count vectors over Arrow's buffers, with their sets' sizes."""

    def __init__(self, packed, n: np.ndarray):
        self.data, self.offsets = binary_parts(packed)
        self.sums, self.length, self.n = _SUMS[self.data], np.diff(self.offsets), n

    def unpacked(self, rows: np.ndarray, length: int, dims: int) -> np.ndarray:
        """Vectors of equal packed length over ``dims`` groups; of finer ones the sums, 15 standing for 15 and more again."""
        packed = self.data[self.offsets[rows][:, None] + np.arange(length)]
        return np.minimum(folded(_HALVES[packed].reshape(len(rows), 2 * length), dims), 15)

    def coarse(self, rows: np.ndarray, length: int, bytes_: int) -> np.ndarray:
        """The same over ``bytes_`` pairs of groups."""
        sums = self.sums[self.offsets[rows][:, None] + np.arange(length)]
        return sums if length == bytes_ else folded(sums, bytes_)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of any lengths over the groups of the shortest."""
        dims = 2 * int(self.length[rows].min())
        out = np.empty((len(rows), dims), np.uint16)
        for length in np.unique(self.length[rows]):
            at = np.flatnonzero(self.length[rows] == length)
            out[at] = self.unpacked(rows[at], int(length), dims)
        return out

    def allowed(self, i: np.ndarray, j: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Whether sizes and summed coordinate minima, over pairs of groups and then over all, allow rows i and j a link.

        ``most`` bounds the bytes at once.
        """
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        keep = 5 * small >= 4 * large
        kinds = self.length[i] << 32 | self.length[j]
        for kind in np.unique(kinds[keep]):
            at = np.flatnonzero(keep & (kinds == kind))
            a, b = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            for vectors, width in ((self.coarse, 1), (self.unpacked, 2)):
                step = max(1, most // (2 * width * max(a, b)))
                for s in range(0, len(at), step):
                    p = at[s : s + step]
                    x, y = (vectors(r[p], size, width * min(a, b)) for r, size in ((i, a), (j, b)))
                    overlap = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                    overlap += np.minimum(self.n[i[p]] - x.sum(axis=1, dtype=np.int64), self.n[j[p]] - y.sum(axis=1, dtype=np.int64))
                    keep[p] = 180 * overlap >= 80 * (self.n[i[p]] + self.n[j[p]])
                at = at[keep[at]]
        return keep


class CountTree:
    """R-tree over points of equal length, packed by size; two levels of boxes of least sizes and greatest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.astype(np.float64)
        spread -= spread.mean(axis=0)
        lead = spread[:, int(spread.var(axis=0).argmax())] if len(points) else spread
        self.order = np.lexsort((lead, sizes)) if len(points) else np.zeros(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.excess = self.sizes - self.points.sum(axis=1, dtype=np.int64)
        self.begin = np.arange(0, len(points), LEAF)

        def boxed(how, of):
            return how.reduceat(of, self.begin, axis=0) if len(points) else of

        self.high, self.high_excess = boxed(np.maximum, self.points), boxed(np.maximum, self.excess)
        self.low_size, self.high_size = boxed(np.minimum, self.sizes), boxed(np.maximum, self.sizes)

    def around(self, at: int) -> np.ndarray:
        """Points that boxes, then their own coordinates, allow a link with point ``at``."""
        c = int(np.flatnonzero(self.order == at)[0])
        size = self.sizes[c]
        bound = np.minimum(self.high, self.points[c]).sum(axis=1, dtype=np.int64) + np.minimum(self.high_excess, self.excess[c])
        fits = (4 * self.low_size <= 5 * size) & (4 * size <= 5 * self.high_size)
        leaves = np.flatnonzero(fits & (180 * np.minimum(bound, size) >= 80 * (size + self.low_size)))
        near = (self.begin[leaves][:, None] + np.arange(LEAF)).ravel()
        near = near[(near < len(self.points)) & (near != c)]
        overlap = np.minimum(self.points[near], self.points[c]).sum(axis=1, dtype=np.int64) + np.minimum(self.excess[near], self.excess[c])
        return self.order[near[180 * overlap >= 80 * (size + self.sizes[near])]]

    def pairs(self):
        """Yield index arrays (i, j), i before j, of points whose summed coordinate minima allow a link."""
        leaves = len(self.begin)
        for a in range(leaves):
            s, e = self.begin[a], min(self.begin[a] + LEAF, len(self.points))
            others = np.arange(a, leaves)
            # sizes rise along leaves: a link needs the larger to be at most 1.25 times the smaller
            others = others[4 * self.low_size[others] <= 5 * self.high_size[a]]
            bound = np.minimum(self.high[a], self.high[others]).sum(axis=1, dtype=np.int64)
            bound += np.minimum(self.high_excess[a], self.high_excess[others])
            others = others[180 * np.minimum(bound, self.high_size[a]) >= 80 * (self.low_size[a] + self.low_size[others])]
            for b in others:
                t, f = self.begin[b], min(self.begin[b] + LEAF, len(self.points))
                overlap = np.minimum(self.points[s:e, None], self.points[None, t:f]).sum(axis=2, dtype=np.int64)
                overlap += np.minimum(self.excess[s:e, None], self.excess[None, t:f])
                near = 180 * overlap >= 80 * (self.sizes[s:e, None] + self.sizes[None, t:f])
                i, j = np.nonzero(near)
                i, j = i + s, j + t
                i, j = i[i < j], j[i < j]
                if len(i):
                    yield self.order[i], self.order[j]


def _analyse(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, sigs, counts, row) of every document; row differs from row to row."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1)
            n, h1, h2, sigs, counts = [], [], [], [], []
            for _, u in shingle_sets(texts):
                with np.errstate(over="ignore"):
                    n.append(len(u))
                    h1.append(int(mix(u ^ _MIXERS[40]).sum().view(np.int64)) if len(u) else 0)
                    h2.append(int(mix(u ^ _MIXERS[41]).sum().view(np.int64)) if len(u) else 0)
                    sigs.append(signatures(u))
                    counts.append(count_vector(u) if len(u) > 3 else b"")
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(sigs, pa.int64()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "h1", "h2", "sigs", "counts"],
            )

    seen = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, h1 long, h2 long, sigs array<long>, counts binary")
    return seen.withColumn("row", F.monotonically_increasing_id())


def _lists(rows: list[np.ndarray], kind):
    import pyarrow as pa

    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([*rows, np.zeros(0, rows[0].dtype if rows else np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _sets(docs: DataFrame, ids: DataFrame, max_ids: int) -> DataFrame:
    """(id, shingles) of the documents named, from their texts."""
    few = F.broadcast(ids) if ids.count() <= max_ids else ids

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [u.view(np.int64) for _, u in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets, pa.int64())], ["id", "shingles"])

    return docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(work, "id long, shingles array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, max_ids: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link; sets are made anew from the texts of the documents named."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = cut(_sets(docs, ids, max_ids))
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    met = pairs.join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("s", "t"))
    return met.filter(180 * both >= 80 * (F.size("s") + F.size("t"))).select("a", "b")


def _by_group(batches, keys: int):
    """Tables of whole groups from batches sorted by their first ``keys`` columns, with each row's group number."""
    import pyarrow as pa

    def numbered(table):
        columns = [table.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(table.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # a group that fills whole batches is gathered before it is looked at again
        if held and all(held[-1].column(i)[-1] == batch.column(i)[-1] for i in range(keys)):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        group = numbered(table)
        last = int(np.searchsorted(group, group[-1]))
        held = table.slice(last).combine_chunks().to_batches()
        if last:
            yield table.slice(0, last), group[:last]
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _pair_batch(rep: np.ndarray, i: np.ndarray, j: np.ndarray, sigs: np.ndarray | None = None):
    """Rows (a, b), and where buckets are named rows (sig) after them."""
    import pyarrow as pa

    a, b = (pa.array(f(rep[i], rep[j]), pa.int64()) for f in (np.minimum, np.maximum))
    if sigs is None:
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])
    none, more = pa.nulls(len(sigs), pa.int64()), pa.nulls(len(i), pa.int64())
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in ([a, none], [b, none], [more, pa.array(sigs, pa.int64())])], ["a", "b", "sig"])


def _leaf_pairs(points: Points, group: np.ndarray, rows: np.ndarray, due=None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i before j, of ``rows`` (a mask over whole groups of up to LEAF rows) that share a group, are due and may link."""
    found = [(np.zeros(0, np.int64),) * 2]
    for far in range(1, min(LEAF, len(group))):
        i = np.flatnonzero((group[far:] == group[:-far]) & rows[far:])
        if not len(i):
            break
        i = i if due is None else i[due(i, i + far)]
        i = i[points.allowed(i, i + far)]
        found.append((i, i + far))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def _searched(rows: DataFrame, leaves: bool) -> DataFrame:
    """(a, b, sig) from rows (sig, slices, rep, centre, n, counts): pairs a, b that may link, and the buckets sig that may have others.

    With ``leaves`` all pairs of buckets of up to LEAF points are bounded and each
    point gives one to the first it may link with. Otherwise, and in larger
    buckets, the tree is searched around the centre. A bucket of several slices has
    its centre in each of them.
    """
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    dealt = rows.withColumn("at", F.explode(F.when(F.col("rep") == F.col("centre"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(own)))

    def work(batches):
        for table, group in _by_group(batches, 2):
            sig, slices, rep, centre, n = (table.column(c).to_numpy() for c in ("sig", "slices", "rep", "centre", "n"))
            points = Points(table.column("counts"), n)
            size = np.bincount(group)
            whole = leaves & (size[group] <= LEAF) & (slices == 1)
            if whole.any():
                i, j = _leaf_pairs(points, group, whole)
                order = np.lexsort((i, j))
                i, j = i[order], j[order]
                first = np.r_[True, j[1:] != j[:-1]][: len(j)]
                yield _pair_batch(rep, i[first], j[first], np.unique(sig[i[~first]]))
            middle = np.full(group[-1] + 1, -1)
            middle[group[rep == centre]] = np.flatnonzero(rep == centre)
            j = np.flatnonzero((rep != centre) & (size[group] <= LEAF) & ~whole)
            i = middle[group[j]]
            keep = points.allowed(i, j)
            yield _pair_batch(rep, i[keep], j[keep], np.unique(sig[j]))
            for g in np.flatnonzero(size > LEAF):
                at = np.arange(*np.searchsorted(group, [g, g + 1]))
                found = CountTree(points.matrix(at), n[at]).around(int(middle[g] - at[0]))
                yield _pair_batch(rep, np.full(len(found), middle[g]), at[found], sig[at[:1]])

    ordered = dealt.repartition("sig", "at").sortWithinPartitions("sig", "at")
    return ordered.select("sig", "at", "slices", "rep", "centre", "n", "counts").mapInArrow(work, "a long, b long, sig long")


def _tree_pairs(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in the same bucket that the R-tree leaves, from rows (sig, slices, rep, comp, n, counts).

    Of a bucket of several slices each task compares two, or one with itself.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    dealt = open_.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    by = ["sig", "lo", "hi"]

    def work(batches):
        for table, group in _by_group(batches, 3):
            lo, hi, own, rep, comp, n = (table.column(c).to_numpy() for c in ("lo", "hi", "own", "rep", "comp", "n"))
            points = Points(table.column("counts"), n)
            size = np.bincount(group)

            def due(i, j, lo=lo, hi=hi, own=own, comp=comp):
                return (comp[i] != comp[j]) & ((lo[i] == hi[i]) | (own[i] != own[j]))

            i, j = _leaf_pairs(points, group, size[group] <= LEAF, due)
            yield _pair_batch(rep, i, j)
            for g in np.flatnonzero(size > LEAF):
                at = np.arange(*np.searchsorted(group, [g, g + 1]))
                for i, j in CountTree(points.matrix(at), n[at]).pairs():
                    keep = due(at[i], at[j])
                    yield _pair_batch(rep, at[i[keep]], at[j[keep]])

    ordered = dealt.repartition(*map(F.col, by)).sortWithinPartitions(*by)
    return ordered.select(*by, "own", "rep", "comp", "n", "counts").mapInArrow(work, "a long, b long").distinct()


def _buckets(chosen: DataFrame, bucket: int, slice_bytes: int) -> DataFrame:
    """(sig, rep, centre, slices): sets that share a group and are of near sizes, from rows (rep, n, sigs).

    Sizes fall into bands so wide that sets which link are in the same or in
    neighbouring ones; a set goes to the buckets of its own band and of the next.
    Of buckets with the same members one is kept. Most groups have one member and
    go by a window, which moves each row once; a count that is joined back would
    move it twice. Counts of buckets are combined before their shuffles. What grows
    with the documents is joined alike at every size and never broadcast.
    """
    single = chosen.select("rep", "n", F.explode("sigs").alias("sig"))
    near = single.withColumn("m", F.count("*").over(Window.partitionBy("sig"))).filter("m > 1")
    band = F.floor(F.log("n") / math.log(BAND))
    banded = cut(near.select(F.explode(F.array(F.xxhash64("sig", band), F.xxhash64("sig", band + 1))).alias("sig"), "rep", "n"))
    # sums of 32-bit hashes: unlike bit_xor they don't cancel where a member stands twice
    marks = [F.sum(F.xxhash64("rep", F.lit(i)).bitwiseAND(0xFFFFFFFF)).alias(f"x{i}") for i in range(2)]
    filled = banded.groupBy("sig").agg(F.count("*").alias("m"), F.max("n").alias("top"), F.min("rep").alias("centre"), *marks).filter("m > 1")
    kept = filled.groupBy("m", "top", "centre", "x0", "x1").agg(F.min("sig").alias("sig"))
    # a point takes some 26 bytes for each of its packed ones: counts twice, their sums and their spread
    width = F.expr(f"26 * {_packed_sql('top')}")
    slices = F.greatest(F.ceil(F.col("m") / bucket), F.ceil(F.col("m") * width / slice_bytes)).cast("int")
    return cut(banded.join(kept.select("sig", "centre", slices.alias("slices")).hint("merge"), "sig").select("sig", "rep", "centre", "slices"))


def jaccard_classes(docs: DataFrame, bucket: int = BUCKET, slice_bytes: int = SLICE_BYTES, max_ids: int = MAX_IDS) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership is doc_id, n_shingles, rep; links (a, b) connect representatives of different sets.

    ``rep`` is the smallest doc_id with the same set, and the document itself if
    it has no words. The links hold every connection between sets, if not every
    single pair: a pair whose ends others connect already is left out. Null and
    empty texts have no shingles and no links. Rows with equal doc_id are taken
    as one document. Rows without doc_id can't be named: they have the rep of an
    equal set or null, and no links; keep_first gives them keys.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(_analyse(docs))
    real = seen.filter("n > 0")
    reps = cut(real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    membership = cut(
        real.select("doc_id", "h1", "h2", "n")
        .join(reps, ["h1", "h2", "n"])
        .select("doc_id", F.col("n").alias("n_shingles"), "rep")
        .union(seen.filter("n = 0").select("doc_id", "n", "doc_id"))
    )
    # a row that stands more than once is one point
    once = real.groupBy("doc_id", "h1", "h2", "n").agg(F.min("row").alias("row"))
    picked = cut(once.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("row"))
    # written once, since every join by it would move all group hashes again
    chosen = real.join(picked.hint("merge"), "row", "left_semi").select(F.col("doc_id").alias("rep"), "n", "sigs", "counts")
    chosen = cut(chosen)
    uncut(seen)
    points = chosen.select("rep", "n", "counts").hint("merge")
    buckets = _buckets(chosen, bucket, slice_bytes)
    first = cut(_searched(buckets.join(points, "rep"), True))
    tested = cut(first.filter("a is not null").select("a", "b").distinct())
    links = cut(_verified(tested, docs, max_ids))
    buckets = cut(buckets.join(first.filter("sig is not null").select("sig").distinct(), "sig", "left_semi"))
    for turn in range(STAR_ROUNDS):
        open_ = _open_buckets(buckets, links, turn).filter("comp != other or rep = centre")
        found = _searched(open_.join(points, "rep"), False).filter("a is not null").select("a", "b").distinct()
        new = cut(found.join(tested, ["a", "b"], "left_anti"))
        found = cut(_verified(new, docs, max_ids))
        tested, links = tested.union(new), links.union(found)
        if not found.head(1):
            break
    # what no star has settled
    open_ = _open_buckets(buckets, links, STAR_ROUNDS).drop("centre", "other")
    new = cut(_tree_pairs(open_.join(points, "rep")).join(tested, ["a", "b"], "left_anti"))
    return membership, cut(links.union(_verified(new, docs, max_ids)))


def _open_buckets(buckets: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """(sig, slices, rep, comp, centre, other) of buckets whose members aren't all connected; centre, of component other, is drawn by hash."""
    comps = cut(connected_components(links)).withColumnRenamed("node", "rep")
    labelled = buckets.select("sig", "slices", "rep").join(comps, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    spread = labelled.groupBy("sig").agg(
        F.min("comp").alias("c1"),
        F.max("comp").alias("c2"),
        F.min(F.struct(F.xxhash64("rep", F.pmod("sig", F.lit(CENTRES)), F.lit(turn)).alias("h"), "rep", "comp")).alias("x"),
    )
    spread = spread.filter("c1 < c2").select("sig", F.col("x.rep").alias("centre"), F.col("x.comp").alias("other"))
    return cut(labelled.join(spread, "sig"))


def jaccard_components(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links and equal sets reach; ``limits`` as jaccard_classes has them."""
    membership, links = jaccard_classes(docs, **limits)
    comps = connected_components(links)
    met = membership.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return met.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each group of near duplicates.

    Rows without doc_id count as documents of their own and come after all that
    have one; without words too, they all stay. Of rows with equal doc_id and no
    words one stays. Where doc_id is null or repeats, a numbered copy is compared.
    """
    if not docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
        found = jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__row")
        named = found.join(rows.select("__row", F.col("doc_id").alias("id")), "__row")
        worded = F.col("n_shingles") > 0
        group = [F.when(worded, F.col("component_id")), F.when(~worded, F.col("id")), F.when(~worded & F.col("id").isNull(), F.col("__row"))]
        firsts = named.groupBy(*(g.alias(f"g{i}") for i, g in enumerate(group))).agg(F.min(F.struct(F.col("id").isNull(), "id", "__row")).alias("x"))
        return rows.join(firsts.select("x.__row"), "__row", "left_semi").select(*docs.columns)
    firsts = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
