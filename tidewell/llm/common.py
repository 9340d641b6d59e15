"""What the training-data operators share: cutting lineage, connected components, vectorised words."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then drops an execution's shuffle files when it ends; nothing reads them after a cut.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    into = os.path.realpath(tempfile.mkdtemp(prefix="tidewell-"))
    atexit.register(shutil.rmtree, into, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{into}/tidewell", "zip", root, "tidewell"))
    sc._tidewell_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a session whose executors are threads of the driver gets a temporary one
    where that is unset; on a cluster rows would be lost in it, so it fails there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there goes when the Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and not a
    recomputation. Files go when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "tidewell")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def uncut(written: DataFrame) -> None:
    """Delete the files of a DataFrame that ``cut`` returned, once all that is made of it is cut itself."""
    for path in {file.rpartition("/")[0] for file in written.inputFiles()}:
        _remove(written.sparkSession, path)


def join_salted(many: DataFrame, few: DataFrame, on: list[str], most: int) -> DataFrame:
    """``many`` joined to the rows of ``few`` that share ``on``, which is never null.

    A key of more than ``most`` rows in ``many`` is dealt to as many salts as keep
    them below, about, and what ``few`` has of it is copied to each. ``many`` is
    read twice: give it as a table that is written already.
    """
    hot = many.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = many.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int"))
    copied = few.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("__salts").join(copied.drop("__salts"), [*on, "__salt"]).drop("__salt")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that links reach.

    Alternates large-star and small-star contraction (Kiveris et al., 2014): each
    round points nodes at the smallest neighbour by a pre-aggregated minimum and
    a join, and ends at a star forest. Nothing is gathered on the driver but a
    count. No links give no rows.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.union(edges.select("v", "u"))
        lowest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        met = both.join(lowest, "x")
        if large:
            out = met.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("y").alias("u"), F.col("m").alias("v")).union(lowest.select("x", "m"))
        return out.filter("u != v").distinct()

    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    )
    seen = None
    for _ in range(limit):
        edges = cut(star(star(edges, True), False))
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# --- vectorised words and hashes, over Arrow's own buffers ---


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_CHARS = odd_constants(256, 11)
_PLACES = odd_constants(1 << 16, 23)


def utf8_batches(array, most: int = 1 << 20):
    """Yield (first row, bytes, offsets) over runs of rows of an Arrow string array with about ``most`` bytes each.

    Null rows count as empty. A single longer text is a run by itself.
    """
    import pyarrow as pa

    if hasattr(array, "combine_chunks"):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if not n:
        return
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, dtype=width)[array.offset : array.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column without nulls."""
    import pyarrow as pa

    array = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    assert not array.null_count
    width = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, dtype=width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """(start, end, row) of each maximal run of bytes that ``separator`` doesn't mark, never across rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: random weights of bytes times random weights of places, summed and mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        jump = np.diff(starts)
        place = np.arange(len(data), dtype=np.int64)
        base = np.zeros(len(data), np.int64)
        base[starts[0]] = starts[0]
        base[starts[1:]] = jump
        place -= np.cumsum(base)
        weighted = _CHARS[data] * _PLACES[place & 0xFFFF]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(weighted, out=total[1:])
        return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
