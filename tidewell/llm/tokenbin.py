"""Packed id matrices: best-fit-decreasing with a segment tree over capacities.

Documents are tokenised, cut losslessly into pieces of at most a row's capacity
and dealt to groups of bounded size. A group is packed largest piece first, each
into the fullest row that still has room: a segment tree over free capacities
finds it in logarithmic time. Rows are written as little-endian id matrices with
the cumulative lengths of their segments and positions that restart in each, and
read back to the documents they hold.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import read, scratch
from tidewell.llm.tokens import default_path, token_ids

CAPACITY = 2048
END_ID = 50256
#: One past the vocabulary, so that no text and no end gives it.
PAD_ID = 50257
#: Types of ids and positions by their bytes; two hold ids up to 65,535.
TYPES = {2: "<u2", 4: "<u4"}
#: Pieces packed together, about: this many bounds a task's memory to some 16 MB of ids.
GROUP = 4096

#: Bytes that a writer buffers before it writes a row group.
ROW_GROUP = 16 << 20

_ROWS = "row_id long, n_segments int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, doc_nos array<bigint>, starts array<bigint>"


class FreeTree:
    """Counts of rows by free capacity in a segment tree: the least capacity of at least ``size`` that some row has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, free: int, by: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(free, row) with the least room that holds ``size``, removed; None if there is none."""
        at = self.leaves + size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the pieces of each row; equal sizes keep their order."""
    tree, rows = FreeTree(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            rows.append([])
            found = (capacity, len(rows) - 1)
        rows[found[1]].append(i)
        tree.put(found[0] - size, found[1])
    return rows


def packed_rows(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID, width: int = 2, group: int = GROUP
) -> DataFrame:
    """One row per packed sequence: its ids and positions (binary, ``capacity`` values each), segments and their sources.

    ``input_ids`` and ``position_ids`` are little-endian unsigned, of ``width``
    bytes each, 2 or 4; an id that doesn't fit fails. Room that is left holds
    ``pad_id`` at position 0. ``cu_seqlens`` runs from 0 over the segments' ends;
    segment i is ids ``starts[i]`` and on of document ``doc_ids[i]``, which is row
    ``doc_nos[i]`` of those packed: repeated rows differ in it. A null or empty text gives its end id alone; longer documents
    are cut at multiples of the capacity, so every id stands in exactly one row.
    A partition packs ``group`` pieces at a time. No rows give no rows.
    """
    path, kind = tokenizer or default_path(), TYPES[width]
    if max(end_id, pad_id, capacity - 1) >= 1 << 8 * width:
        raise ValueError(f"{width} bytes don't hold the end id, the pad id and every position")

    def work(batches):
        import pyarrow as pa

        base, made, seen = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[int, int, int, np.ndarray]] = []

        def flush():
            nonlocal made
            out = []
            for row in best_fit_decreasing(np.array([len(x[3]) for x in held]), capacity):
                pieces = [held[i] for i in row]
                docs_, nos, starts, parts = zip(*pieces, strict=True)
                ids, positions = np.full(capacity, pad_id, kind), np.zeros(capacity, kind)
                ends = np.cumsum([0, *map(len, parts)])
                for p, s in zip(parts, ends, strict=False):
                    ids[s : s + len(p)] = p
                    positions[s : s + len(p)] = np.arange(len(p))
                out.append((base + made, len(pieces), int(ends[-1]), ids.tobytes(), positions.tobytes(), ends.tolist(), docs_, nos, starts))
                made += 1
            held.clear()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
            names = [x.split()[0] for x in _ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(token_ids(path, text.as_py()), np.uint32(end_id)).astype("<u4")
                if ids.max() >= 1 << 8 * width:
                    raise ValueError(f"{width} bytes don't hold id {ids.max()}")
                for s in range(0, len(ids), capacity):
                    held.append((doc, base + seen, s, ids[s : s + capacity]))
                    if len(held) >= group:
                        yield flush()
                seen += 1
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _ROWS)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the ids of a file's rows joined are a matrix of rows times capacity, and so are the positions."""
    packed.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)


def read_documents(packed: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, doc_no, ids) back from packed rows: segments cut out and joined in order, for checks of losslessness.

    Binary values are sliced by SQL; a document gathers only its own pieces.
    """
    segments = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_segments") - 1)))
    piece = F.expr(f"substring(input_ids, {width} * cu_seqlens[i] + 1, {width} * (cu_seqlens[i + 1] - cu_seqlens[i]))")
    cut_out = segments.select(F.expr("doc_ids[i]").alias("doc_id"), F.expr("doc_nos[i]").alias("doc_no"), F.expr("starts[i]").alias("start"), F.hex(piece).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "")
    return cut_out.groupBy("doc_id", "doc_no").agg(F.unhex(joined).alias("ids"))


def op10_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices of all documents and gives the rows as they are read back."""
    path = scratch(spark, "matrices")
    write_matrices(packed_rows(read(spark, sf_dir, "documents").select("doc_id", "text")), path)
    return read_matrices(spark, path)
