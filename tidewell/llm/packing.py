"""Bounded-space online packing of token ids into fixed-size sequences.

Each partition keeps a fixed number of open windows. A document's ids, an end id
after them, are cut at full windows; what is left goes best-fit into the open
window with the least room for it. If none has room, the fullest window is
emitted and a new one opened. When the input ends, the windows still open are
leftovers: they are merged across partitions by the same rule.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read
from tidewell.llm.tokens import default_path, token_ids

CAPACITY = 1024
#: Open windows of a partition.
OPEN = 64
END_ID = 0
#: Leftover windows that one task merges, about: a thousand partitions' worth of a few.
MERGE = 4096

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


class OpenWindows:
    """At most ``most`` windows by fill: a placement costs a search in a sorted list of at most that many."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.fills: list[tuple[int, int]] = []  # (fill, window) in order
        self.made = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window emitted to make room or None) for ``size`` ids; a full window's worth needs no open one."""
        emitted = None
        if size == self.capacity:
            self.made += 1
            return self.made - 1, 0, None
        at = bisect.bisect_right(self.fills, (self.capacity - size, 1 << 62)) - 1
        if at >= 0:
            fill, window = self.fills.pop(at)
        else:
            if len(self.fills) >= self.most:
                emitted = self.fills.pop()[1]
            fill, window = 0, self.made
            self.made += 1
        if fill + size < self.capacity:
            bisect.insort(self.fills, (fill + size, window))
        return window, fill, emitted


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, most: int = OPEN, merge: int = MERGE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; a null text is empty and gives its end id alone.
    Repeated rows are packed as rows of their own. Sequence ids are unique; offsets
    of a sequence run from 0 without gaps. No rows give no rows.
    """
    path = tokenizer or default_path()

    def work(batches):
        import pyarrow as pa

        base = (TaskContext.get().partitionId() + 1) << 32
        windows = OpenWindows(capacity, most)
        held: dict[int, list] = {}

        def batch(rows, is_open):
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * len(rows), pa.bool_())], [*names, "open"])

        for b in batches:
            done = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(token_ids(path, text.as_py()), np.uint32(END_ID)).astype("<u4")
                total = len(ids)
                for start in range(0, total, capacity):
                    part = ids[start : start + capacity]
                    window, offset, emitted = windows.place(len(part))
                    if emitted is not None:
                        done += held.pop(emitted)
                    row = (doc, start, len(part), zlib.crc32(part.tobytes()), total, base + window, offset)
                    if offset + len(part) == capacity:
                        done += [*held.pop(window, ()), row]
                    else:
                        held.setdefault(window, []).append(row)
            yield batch(done, False)
        yield batch([r for rows in held.values() for r in rows], True)

    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _PIECES))
    left = pieces.filter("open")
    windows = left.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    moved = cut(_merge(windows, capacity, most, merge))
    closed = pieces.filter("not open").drop("open")
    again = left.drop("open").join(moved, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset")
    )
    return closed.union(again)


def _merge(windows: DataFrame, capacity: int, most: int, merge: int) -> DataFrame:
    """(sequence_id, into, base): where each leftover window goes, whole. Larger ones are placed first, in tasks of about ``merge`` windows."""

    def work(batches):
        import pyarrow as pa

        open_ = OpenWindows(capacity, most)
        base = -((TaskContext.get().partitionId() + 1) << 32)
        for b in batches:
            rows = [open_.place(f) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([base - w for w, _, _ in rows], pa.int64()), pa.array([o for _, o, _ in rows], pa.int64())],
                ["sequence_id", "into", "base"],
            )

    tasks = max(1, -(-windows.count() // merge))
    dealt = windows.repartition(tasks, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("fill"), "sequence_id")
    return dealt.select("sequence_id", "fill").mapInArrow(work, "sequence_id long, into long, base long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
