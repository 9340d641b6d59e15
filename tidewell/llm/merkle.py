"""Merkle manifest of a data set: a tree over each group's rows, one over the groups, and every row's proof.

Rows are range-sorted by group and order and checkpointed, so a partition holds
the same run of rows whenever it is read. One count a partition (its last group's
rows, as in zipWithIndex) tells where each partition begins within its group. With
that offset a partition builds, alone, every aligned subtree that is complete
within it, up to ``HEIGHT`` levels. Nodes at a partition's ragged ends are shuffled
by their coordinate, (group, block), and finished there; so are the upper levels,
``HEIGHT`` at a time. Paths then go down again by joins on coordinates of which
each has at most ARITY ** HEIGHT rows, so a hot group is spread like any other.
"""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.llm.common import cut, read, shared_dir

ARITY = 3
#: Levels that one task builds at once; a block has ARITY ** HEIGHT leaves at most.
HEIGHT = 7

_PATH = "array<struct<l:binary,r:binary>>"
_NODES = f"g string, level int, idx long, digest binary, n long, up {_PATH}, to_idx long, made boolean"


def parent_digest(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as lower-case hex text, one after the other."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def climb(given: list[tuple[int, int, bytes]], n: int | None, top: int, arity: int) -> tuple[dict, dict]:
    """(digests, steps) of what ``given`` (level, idx, digest) nodes complete below level ``top``.

    ``n`` is the number of leaves of the whole tree where it ends among these nodes,
    else None. A run is complete when all its children are here; a shorter last one
    when they end where the tree does. steps[level, idx] is (left siblings, right
    siblings) of a node whose parent is here.
    """
    digests = {(level, i): d for level, i, d in given}
    by_level: dict[int, list[int]] = {}
    for level, i, _ in given:
        by_level.setdefault(level, []).append(i)
    steps: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    for level in range(min(by_level, default=top), top):
        width = None if n is None else -(-n // arity**level)
        if width == 1:
            break
        runs: dict[int, list[int]] = {}
        for i in sorted(by_level.get(level, ())):
            runs.setdefault(i // arity, []).append(i)
        for p, members in runs.items():
            last = arity * (p + 1) if width is None else min(arity * (p + 1), width)
            if len(members) < last - arity * p:
                continue
            children = [digests[level, i] for i in members]
            digests[level + 1, p] = parent_digest(children)
            by_level.setdefault(level + 1, []).append(p)
            for k, i in enumerate(members):
                steps[level, i] = b"".join(children[:k]), b"".join(children[k + 1 :])
    return digests, steps


def _paths(steps: dict, starts: list[tuple[int, int]], arity: int) -> list[tuple[list, tuple[int, int]]]:
    """For each start, the steps up from it and the node where they end."""
    known: dict[tuple[int, int], tuple[list, tuple[int, int]]] = {}

    def up(node):
        if node not in known:
            step = steps.get(node)
            if step is None:
                known[node] = [], node
            else:
                above, end = up((node[0] + 1, node[1] // arity))
                known[node] = [step, *above], end
        return known[node]

    return [up(s) for s in starts]


def _path_array(paths: list[list]):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(paths) + 1, np.int32)
    np.cumsum([len(p) for p in paths], out=offsets[1:])
    flat = [s for p in paths for s in p]
    sides = [pa.array([s[k] for s in flat], pa.binary()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(sides, ["l", "r"]))


def _offsets(ordered: DataFrame) -> tuple[dict[int, tuple[int, int]], int]:
    """{partition: (leaves of its first group before it, all leaves of its last group)} and the largest group's size.

    One row a partition reaches the driver.
    """

    def count(batches):
        import pyarrow as pa

        groups: list = []  # first and last (group, count)
        largest = 0
        for b in batches:
            for run in b.column(0).to_pylist() if b.num_rows else []:
                if groups and groups[-1][0] == run:
                    groups[-1][1] += 1
                else:
                    largest = max(largest, groups[-1][1] if groups else 0)
                    groups = [groups[0], [run, 1]] if groups else [[run, 1]]
        if groups:
            first, last = groups[0], groups[-1]
            row = [TaskContext.get().partitionId(), *first, *last, len(groups) == 1, largest]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["p", "g", "n", "last_g", "last_n", "one", "largest"])

    rows = sorted(ordered.select("g").mapInArrow(count, "p int, g string, n long, last_g string, last_n long, one boolean, largest long").collect())
    before, run_of, totals = {}, {}, []
    held: tuple | None = None
    for r in rows:
        if held is None or held[0] != r["g"]:
            totals.append(0)
        before[r["p"]] = totals[-1]
        totals[-1] += r["n"]
        if not r["one"]:
            totals.append(r["last_n"])
        held = (r["last_g"],)
        run_of[r["p"]] = len(totals) - 1
    return {p: (before[p], totals[run_of[p]]) for p in before}, max([0, *totals, *(r["largest"] for r in rows)])


def _local(ordered: DataFrame, offsets: dict, arity: int, height: int) -> DataFrame:
    """``ordered`` (g, digest, ...) with the top of each row's local subtree (level, idx), its path there and, once a top, that node's digest and n."""
    block = arity**height

    def build(batches):
        import pyarrow as pa

        before, last_total = offsets.get(TaskContext.get().partitionId(), (0, 0))
        held, group, at = None, (), before

        def segment(table, first: int, n: int | None):
            digests, steps = climb([(0, first + k, d) for k, d in enumerate(table.column("digest").to_pylist())], n, height, arity)
            paths = _paths(steps, [(0, first + k) for k in range(len(table))], arity)
            tops = [end for _, end in paths]
            fresh = [k == 0 or tops[k] != tops[k - 1] for k in range(len(tops))]
            more = [
                pa.array([t[0] for t in tops], pa.int32()), pa.array([t[1] for t in tops], pa.int64()), _path_array([p for p, _ in paths]),
                pa.array([digests[t] if f else None for t, f in zip(tops, fresh, strict=True)], pa.binary()), pa.array([n] * len(tops), pa.int64()),
            ]
            for name, values in zip(("level", "idx", "up", "top", "n"), more, strict=True):
                table = table.append_column(name, values)
            return table.combine_chunks().to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([held, table]) if held is not None else table
            groups = table.column("g").to_pylist()
            start = 0
            while start < len(groups):
                if group and group[0] != groups[start]:
                    at = 0
                group = (groups[start],)
                end, most = start, start + block - at % block
                while end < len(groups) and end < most and groups[end] == group[0]:
                    end += 1
                if end == len(groups):
                    break  # whether the group goes on isn't known yet
                n = at + end - start
                yield from segment(table.slice(start, end - start), at, n if groups[end] != group[0] else None)
                at, start = n, end
            held = table.slice(start)
        if held is not None and len(held):
            n = at + len(held)
            yield from segment(held, at, n if n == last_total else None)

    added = ordered.sparkSession.createDataFrame([], f"level int, idx long, up {_PATH}, top binary, n long").schema
    return ordered.mapInArrow(build, StructType([*ordered.schema.fields, *added.fields]))


def _finish(nodes: DataFrame, top: int, arity: int) -> DataFrame:
    """Nodes (g, level, idx, digest, n) of levels up to ``top``, met by block: each with its path to the block's node, and that node (``made``)."""

    def block(table):
        import pyarrow as pa

        rows = table.to_pylist()
        given = [(r["level"], r["idx"], r["digest"]) for r in rows]
        n = max((r["n"] for r in rows if r["n"] is not None), default=None)
        to = int(rows[0]["to_idx"])
        # the tree ends here; beyond the first block runs go on up to ``top`` though one node is left
        digests, steps = climb(given, n, top, arity)
        paths = _paths(steps, [(level, i) for level, i, _ in given], arity)
        ends = {end for _, end in paths}
        if len(ends) != 1:
            raise ValueError(f"block {to} of group {rows[0]['g']!r} has {len(ends)} ends")
        g, count = rows[0]["g"], len(rows)
        columns = [
            pa.array([g] * (count + 1), pa.string()), pa.array([r["level"] for r in rows] + [top], pa.int32()), pa.array([r["idx"] for r in rows] + [to], pa.int64()),
            pa.array([None] * count + [digests[ends.pop()]], pa.binary()), pa.array([None] * count + [n], pa.int64()), _path_array([p for p, _ in paths] + [[]]),
            pa.array([to] * (count + 1), pa.int64()), pa.array([False] * count + [True], pa.bool_()),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _NODES.replace(f"up {_PATH}", "up x").split(", ")])

    power = F.pow(F.lit(float(arity)), F.lit(top) - F.col("level")).cast("long")
    dealt = nodes.select("g", "level", "idx", "digest", "n", F.floor(F.col("idx") / power).cast("long").alias("to_idx"))
    return dealt.groupBy("g", "to_idx").applyInArrow(block, _NODES)


class Tree:
    """Trees over the rows of each group of ``rows`` (g string, ``order``..., digest binary, ...); rows sort by ``order``, then digest.

    ``roots`` has (g, digest). Groups and orders may be null, which sort first;
    equal rows are leaves of their own. No rows give no trees.
    """

    def __init__(self, rows: DataFrame, order: list[str], arity: int = ARITY, height: int = HEIGHT):
        spark = rows.sparkSession
        shared_dir(spark)
        keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "digest")]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).checkpoint()
        offsets, largest = _offsets(ordered)
        self.leaves = cut(_local(ordered, offsets, arity, height))
        nodes = self.leaves.filter("top is not null").select("g", "level", "idx", F.col("top").alias("digest"), "n")
        self.stages, top = [], height
        while True:
            met = cut(_finish(nodes, top, arity))
            self.stages.append(met.filter("not made").select("g", "level", "idx", "up", "to_idx"))
            nodes = met.filter("made").select("g", "level", "idx", "digest", "n")
            if arity**top >= largest:
                break
            top += height
        self.roots = nodes.select("g", "digest")

    def with_paths(self, above: DataFrame) -> DataFrame:
        """Every leaf with its whole path: within its group's tree and, after that, the path that ``above`` (g, path, ...) has for the group."""
        known = above.withColumn("__idx", F.lit(0).cast("long"))
        extra = [c for c in above.columns if c not in ("g", "path")]
        for stage in reversed(self.stages):
            low, high = stage.alias("low"), known.alias("high")
            met = low.join(high.hint("merge"), F.expr("low.g <=> high.g and low.to_idx = high.__idx"))
            known = met.select("low.g", F.col("low.level").alias("__level"), F.col("low.idx").alias("__idx"), F.concat("low.up", "high.path").alias("path"), *[f"high.{c}" for c in extra])
        leaf, top = self.leaves.alias("leaf"), known.alias("high")
        met = leaf.join(top.hint("merge"), F.expr("leaf.g <=> high.g and leaf.level = high.__level and leaf.idx = high.__idx"))
        own = [F.col(f"leaf.{c}") for c in self.leaves.columns if c not in ("level", "idx", "up", "top", "n")]
        return met.select(*own, F.concat("leaf.up", "high.path").alias("path"), *[f"high.{c}" for c in extra])


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def fold(start: Column, path: str = "path") -> Column:
    """The root, as hex, that ``start`` (binary) gives with the siblings of ``path``."""
    return F.aggregate(F.col(path), hex_text(start), lambda acc, s: F.sha2(F.concat(hex_text(s["l"]), acc, hex_text(s["r"])), 256))


def proof_digest(path: str = "path") -> Column:
    """SHA-256 of all siblings' hex text, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: hex_text(F.concat(s["l"], s["r"])))), 256)


def row_digest(*columns: Column) -> Column:
    """SHA-256, binary, of each value as UTF-8 byte count, ``:`` and text, or ``-`` where null."""
    said = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]), 256))


def manifest(rows: DataFrame, group: str, order: str, height: int = HEIGHT) -> DataFrame:
    """``rows`` (with a binary ``digest``) and subroot, root (hex) and path: array of (l, r), the siblings left and right of each level up to the root.

    Leaves of a group ascend by ``order``, nulls first and equal ones by digest;
    groups ascend by name, null first, as UTF-8 bytes. The only leaf of the only
    group is the root, with no path. Other columns stay, but for those of the
    results' names.
    """
    others = [c for c in rows.columns if c not in (order, "digest", "subroot", "root", "path")]
    tree = Tree(rows.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), "digest", F.struct(*others).alias("kept")), ["o"], height=height)
    above = Tree(tree.roots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("name"), "digest"), ["name"], height=height)
    tops = above.with_paths(above.roots.select("g", F.array().cast(_PATH).alias("path"), hex_text(F.col("digest")).alias("root")))
    tops = tops.select(F.col("name").alias("g"), "path", hex_text(F.col("digest")).alias("subroot"), "root")
    return tree.with_paths(tops).select(F.col("o").alias(order), "digest", "kept.*", "subroot", "root", "path")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(text: Column) -> Column:
        return row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), F.when(tampers, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))
    proven = manifest(rows, "source", "doc_id")
    folded = proven.withColumn("folded_root", fold(F.coalesce("changed", "digest")))
    return folded.select(
        "doc_id", hex_text(F.col("digest")).alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
