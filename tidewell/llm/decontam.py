"""Benchmark decontamination by spaced seeds.

Texts are lower-cased runs of letters and digits. A seed is a fixed mask over
neighbouring tokens; its hash takes the tokens under its ones and ignores the
others, so a substituted token breaks only the seeds that look at it. Hashes of
all benchmark positions are joined to those of all document positions that a
bitmap of the benchmark's hashes lets pass. Around each hit the texts are aligned
and the best run, a match counting 1 and a substitution -2, is taken; it is an
overlap if it matches enough tokens. An item of fewer than LEAST_ITEM tokens has
one hash, of all its tokens, and overlaps where a text holds it whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, join_salted, mix, odd_constants, read, utf8_batches, word_hashes, word_spans

#: Fixed masks: tokens looked at from a position on.
MASKS = [(0, 1, 2, 3, 4), (0, 1, 3, 6, 7), (0, 2, 3, 5, 8), (0, 1, 4, 5, 6)]
#: Matching tokens of an overlap; a shorter item must match whole but for a fifth of its tokens.
LEAST_MATCH = 13
#: Items of fewer tokens must match whole; documents go for them only if they hold nothing else.
LEAST_ITEM = 8
MISMATCH = 2
#: Bits of the bitmap that executors hold; a larger benchmark lets more seeds pass to the join.
MAX_BITS = 1 << 27
#: Keys of documents with hits up to this number are sent to all executors; beyond it a join shuffles texts.
MAX_KEYS = 1_000_000
#: Rows with the same seed, item or document that a task joins, about.
MEETINGS = 20_000

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WEIGHTS = odd_constants(16, 91)
#: Every mask, then for items of 1 token and on the tokens of the whole item.
_SHAPES = [*MASKS, *(tuple(range(n)) for n in range(1, LEAST_ITEM))]


def token_hashes(array):
    """Yield (first row, token hashes, offsets of the rows in them) over an Arrow string array."""
    import pyarrow.compute as pc

    for first, data, offsets in utf8_batches(pc.utf8_lower(array)):
        starts, ends, row = word_spans(data, offsets, _APART)
        yield first, word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def seeds(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The hash of a mask at each position where it fits."""
    at = MASKS[mask]
    n = len(tokens) - at[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = odd_constants(16, 91)
    total = np.full(n, np.uint64(mask + 1))
    with np.errstate(over="ignore"):
        for i in at:
            total += tokens[i : i + n] * weights[i]
        return mix(total)


def seeds(tokens: np.ndarray, shape: int) -> np.ndarray:
    """The hash of a shape at each position where it fits."""
    at = _SHAPES[shape]
    n = len(tokens) - at[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(shape + 1))
    with np.errstate(over="ignore"):
        for i in at:
            total += tokens[i : i + n] * _WEIGHTS[i]
        return mix(total)


def shapes_of(n: int) -> range:
    """Shapes that an item of n tokens is hashed by."""
    return range(len(MASKS)) if n >= LEAST_ITEM else range(len(MASKS) + n - 1, len(MASKS) + n)


def needed(n: int) -> int:
    """Tokens of an item of n that a text must match."""
    return n if n < LEAST_ITEM else min(LEAST_MATCH, -(-4 * n // 5))


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(matches, begin, end) of the run of greatest score, the first of equal ones."""
    score = np.where(equal, 1, -MISMATCH)
    total = np.concatenate([[0], np.cumsum(score)])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    begin = int(total[: end + 1].argmin())
    return int(equal[begin:end].sum()), begin, end


def _batch(columns: list, schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _tokenised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, text) as (keys, tokens)."""
    schema = ", ".join([f"{k} long" for k in keys] + ["tokens array<long>"])

    def work(batches):
        for batch in batches:
            tokens = [t[o[r] : o[r + 1]].view(np.int64) for _, t, o in token_hashes(batch.column(len(keys))) for r in range(len(o) - 1)]
            yield _batch([*(batch.column(i) for i in range(len(keys))), tokens], schema)

    return rows.select(*keys, "text").mapInArrow(work, schema)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(hash, no, item_at) of every position of ``items`` (no, tokens)."""
    schema = "hash long, no long, item_at long"

    def work(batches):
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            for no, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens.values.to_numpy().view(np.uint64)
                for shape in shapes_of(len(tokens)) if len(tokens) else ():
                    h = seeds(tokens, shape).view(np.int64)
                    for to, x in zip(out, (h, np.full(len(h), no), np.arange(len(h))), strict=True):
                        to.append(x)
            yield _batch([np.concatenate(x) for x in out], schema)

    return items.select("no", "tokens").mapInArrow(work, schema)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each hash; words are or-ed together before they reach the driver, at most ``bits`` / 64 of them."""

    def work(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_places(h, bits)))
            word, mask = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            masks = np.bitwise_or.reduceat(mask, first) if len(word) else mask
            yield _batch([word[first], masks.view(np.int64)], "word long, mask long")

    got = hashes.select("hash").mapInArrow(work, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little").view(bool)


def _text_seeds(docs: DataFrame, bitmap: np.ndarray, shapes: list[int]) -> DataFrame:
    """(k1, k2, hash, doc_at) of the positions of ``docs`` (k1, k2, text) whose seed the bitmap lets pass."""
    schema = "k1 long, k2 long, hash long, doc_at long"
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def work(batches):
        bitmap = np.unpackbits(held.value).view(bool)
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for first, tokens, offsets in token_hashes(batch.column(2)):
                for shape in shapes:
                    h = seeds(tokens, shape)
                    one, two = _places(h, len(bitmap))
                    at = np.flatnonzero(bitmap[one])
                    at = at[bitmap[two[at]]]
                    row = np.searchsorted(offsets, at, "right") - 1
                    inside = at + _SHAPES[shape][-1] < offsets[row + 1]
                    at, row = at[inside], row[inside]
                    if len(at):
                        yield _batch([keys[0][first + row], keys[1][first + row], h[at].view(np.int64), at - offsets[row]], schema)

    return docs.select("k1", "k2", "text").mapInArrow(work, schema)


def _aligned(cases: DataFrame) -> DataFrame:
    """The best run of each of ``cases`` (k1, k2, item_id, n, size, shift, lo, x, y), x and y being what lies opposite; too short ones go."""
    schema = "k1 long, k2 long, item_id long, doc_tokens long, matched long, length long, doc_start long, item_start long"

    def work(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            found = []
            for (k1, k2, item, n, size, shift, lo), x, y in zip(zip(*columns, strict=True), batch.column(7), batch.column(8), strict=True):
                matched, s, e = best_run(x.values.to_numpy() == y.values.to_numpy())
                if matched >= needed(n):
                    found.append((k1, k2, item, size, matched, e - s, lo + s + shift, lo + s))
            if found:
                yield _batch(list(zip(*found, strict=True)), schema)

    return cases.select("k1", "k2", "item_id", "n", "size", "shift", "lo", "x", "y").mapInArrow(work, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k1 and k2, 128 bits of hash of doc_id and text."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "text")})


def _overlaps(docs: DataFrame, items: DataFrame, max_bits: int, max_keys: int, meetings: int) -> DataFrame | None:
    """Best overlap of each of ``docs`` (k1, k2, text) and item, or None for a benchmark without tokens."""
    known = items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    bench = _tokenised(known, ["item_id"]).withColumn("n", F.size("tokens")).filter("n > 0")
    bench = cut(bench.withColumn("no", F.monotonically_increasing_id()))
    wanted = cut(_item_seeds(bench))
    count = wanted.count()
    if not count:
        return None
    short = [r["n"] for r in bench.filter(F.col("n") < LEAST_ITEM).select("n").distinct().collect()]
    shapes = [*range(len(MASKS)), *(shapes_of(n)[0] for n in sorted(short))]
    bits = min(max_bits, 1 << max(16, (64 * count - 1).bit_length()))
    hits = cut(_text_seeds(docs, _bitmap(wanted, bits), shapes))
    met = join_salted(hits, wanted, ["hash"], meetings)
    cases = cut(met.select("k1", "k2", "no", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct())
    keys = cut(cases.select("k1", "k2").distinct())
    few = F.broadcast(keys) if keys.count() <= max_keys else keys
    texts = _tokenised(docs.join(few, ["k1", "k2"], "left_semi"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    met = join_salted(cases, bench.withColumnRenamed("tokens", "item"), ["no"], meetings)
    met = join_salted(met, texts, ["k1", "k2"], meetings)
    met = met.withColumns({"size": F.size("tokens"), "lo": F.greatest(F.lit(0), -F.col("shift"))})
    met = met.withColumn("m", F.least("n", F.col("size") - F.col("shift")) - F.col("lo")).filter("m > 0")
    opposite = {"x": F.expr("slice(tokens, int(lo + shift + 1), int(m))"), "y": F.expr("slice(item, int(lo + 1), int(m))")}
    return _aligned(met.withColumns(opposite))


def benchmark_overlaps(docs: DataFrame, items: DataFrame, max_bits: int = MAX_BITS, max_keys: int = MAX_KEYS, meetings: int = MEETINGS) -> DataFrame:
    """(doc_id, item_id, matched, length, doc_start, item_start, doc_tokens): each document's best overlap with each benchmark item.

    Starts and lengths count tokens; of equal matches the shortest, then the
    earliest counts. Null and empty texts overlap nothing; items without item_id or
    tokens match nothing; rows equal in doc_id and text count once; item rows of
    equal item_id are texts of one item. An empty benchmark gives no rows. The
    limits change no result.
    """
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = _overlaps(keyed, items, max_bits, max_keys, meetings)
    columns = ["doc_id", "item_id", "matched", "length", "doc_start", "item_start", "doc_tokens"]
    if found is None:
        return docs.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in columns))
    order = F.struct("matched", (-F.col("length")).alias("l"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "doc_tokens")
    best = cut(found.groupBy("k1", "k2", "item_id").agg(F.max(order).alias("b")))
    named = keyed.join(best.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "doc_id").distinct()
    out = best.join(named, ["k1", "k2"])
    return out.select("doc_id", "item_id", "b.matched", (-F.col("b.l")).alias("length"), (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), "b.doc_tokens")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that overlap a benchmark item by LEAST_ITEM tokens or more, or that are a shorter item and nothing else."""
    keyed = _keyed(docs.select(F.col("doc_id"), "text"))
    found = _overlaps(keyed, items, MAX_BITS, MAX_KEYS, MEETINGS)
    if found is None:
        return docs
    dirty = cut(found.filter((F.col("matched") >= LEAST_ITEM) | (F.col("matched") == F.col("doc_tokens"))).select("k1", "k2").distinct())
    k1, k2 = F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(F.lit(1), docs["doc_id"], docs["text"])
    return docs.join(dirty, (k1 == dirty["k1"]) & (k2 == dirty["k2"]), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
