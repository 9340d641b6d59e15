"""Sharding by a Hilbert curve over quantised metadata, in DataFrame functions only.

Every dimension is quantised to 2^bits cells of near equal row counts, values in
order; a row's cells give its index on the Hilbert curve (Skilling, 2004). Rows
are sorted by that index and cut into equal runs, so a shard covers a compact
region of all dimensions and readers can skip shards by their ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read

BITS = 4


def quantise(rows: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with one cell column ``__cell_<i>`` per dimension, 0 to 2^bits - 1.

    A value's cell is the share of rows with smaller values, so cells hold near
    equal counts; a value of which there are many fills several cells' room but
    lies in one. Nulls form the lowest value. Per-value counts are summed in a
    range partitioning with offsets, whatever their number; only the least value
    of each cell is broadcast.
    """
    cells = 1 << bits
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    for i, dim in enumerate(dims):
        counts = cut(rows.groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n")))
        by = F.col("v").asc_nulls_first()
        ordered = counts.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("__id", F.monotonically_increasing_id())
        ordered = cut(ordered).select("v", "n", part.alias("__part"), place.alias("__place"))
        sums = ordered.groupBy("__part").agg(F.sum("n").alias("__sum"))
        offset = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sums.select("__part", offset.alias("__before"), F.sum("__sum").over(Window.partitionBy()).alias("__n"))
        inside = F.sum("n").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
        below = F.coalesce(inside, F.lit(0)) + F.col("__before")
        placed = ordered.join(F.broadcast(offsets), "__part").select("v", F.floor(below * cells / F.col("__n")).cast("int").alias("c"))
        least = placed.filter("v is not null").groupBy("c").agg(F.min("v").alias("v"))
        bounds = least.agg(F.collect_list(F.struct("c", "v")).alias("__bounds"))
        cell = F.expr(f"coalesce(array_max(transform(filter(__bounds, x -> x.v <= `{dim}`), x -> x.c)), 0)")
        rows = rows.crossJoin(F.broadcast(bounds)).withColumn(f"__cell_{i}", cell).drop("__bounds")
    return rows


def hilbert_index(rows: DataFrame, cells: list[str], bits: int = BITS, out: str = "hilbert") -> DataFrame:
    """Skilling's transform, one projection a step so that no expression repeats another."""
    n = len(cells)
    x = [f"__x{i}" for i in range(n)]
    rows = rows.withColumns({x[i]: F.col(c).cast("long") for i, c in enumerate(cells)})
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            on = F.col(x[i]).bitwiseAND(q) != 0
            if i == 0:
                rows = rows.withColumn(x[0], F.when(on, F.col(x[0]).bitwiseXOR(q - 1)).otherwise(F.col(x[0])))
            else:
                swap = F.when(on, F.lit(0)).otherwise(F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(q - 1))
                flip = F.when(on, F.lit(q - 1)).otherwise(F.lit(0))
                rows = rows.withColumns({"__t": swap, "__p": flip})
                rows = rows.withColumns(
                    {x[0]: F.col(x[0]).bitwiseXOR(F.col("__t")).bitwiseXOR(F.col("__p")), x[i]: F.col(x[i]).bitwiseXOR(F.col("__t"))}
                )
    for i in range(1, n):
        rows = rows.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn: Column = F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(F.col(x[n - 1]).bitwiseAND(q) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
    rows = rows.withColumn("__t", turn)
    index: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("__t")), b).bitwiseAND(1)
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return rows.withColumn(out, index).drop(*x, "__t", "__p")


def hilbert_shards(rows: DataFrame, key: str, dims: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """``rows`` (without wide columns) with hilbert, shard and slot, of which each replaces one there already.

    Law `rows`: sorted by curve index, then key, row r of n is in shard
    floor(r * shards / n), so counts differ by one at most; slot counts from 0 in
    each shard. Rows with equal indices and keys take any order among themselves.
    Places come from one range partitioning, whose partitions are counted and
    offset; no rows meet in one task. No rows give no rows.
    """
    kept = [c for c in rows.columns if c not in ("hilbert", "shard", "slot")]
    celled = quantise(rows.select(*kept), dims, bits)
    cells = [f"__cell_{i}" for i in range(len(dims))]
    indexed = hilbert_index(celled, cells, bits).drop(*cells)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id holds the partition above bit 33 and the place in it below
    ordered = cut(
        indexed.repartitionByRange(parts, "hilbert", key).sortWithinPartitions("hilbert", key).withColumn("__id", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__n"))
    ranked = ordered.join(F.broadcast(offsets), part == F.col("__part")).withColumn("__rank", F.col("__before") + place)
    ranked = ranked.withColumn("shard", F.expr(f"__rank * {shards} div __n").cast("int"))
    first = F.expr("(shard * __n + %d) div %d" % (shards - 1, shards))
    return ranked.select(*kept, "hilbert", "shard", (F.col("__rank") - first).alias("slot"))


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard its rows and the least and greatest value of every dimension: what a reader prunes files by."""
    sides = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *sides)


def write_shards(docs: DataFrame, sharded: DataFrame, key: str, path: str) -> None:
    """Write ``docs`` partitioned by shard, each file sorted by curve index; the key joins rows with their places."""
    placed = docs.join(sharded.select(key, "shard", "hilbert"), key)
    placed.repartition("shard", F.pmod(F.col("hilbert"), F.lit(16))).sortWithinPartitions("shard", "hilbert", key).write.partitionBy("shard").parquet(path)


def size_rank(size: Column) -> Column:
    """An order-preserving class of a positive size: its bit length and the three bits below the highest, at most 512 values."""
    length = F.length(F.bin(size))
    low = F.when(length > 3, F.expr("shiftright(size, cast(length(bin(size)) - 4 as int)) & 7")).otherwise(0)
    return length * 8 + low


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        "lang",
        "source",
    ).withColumn("size_rank", size_rank(F.col("size")))
    placed = hilbert_shards(cut(rows), "doc_id", ["source", "lang", "size_rank"], 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
