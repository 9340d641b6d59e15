"""URL filters: exact rule look-up by a cascade of Bloom filters, without joins.

A rule is a host and a path prefix. It fits a url if its host is the url's or a
parent domain and the url's path starts with its path; the longest fitting rule
(host plus path; then the longer host) decides. A url's candidate keys are its
host suffixes of as many labels as some rule has, each with the path prefixes of
as many characters as some rule has, so their number depends on the rules alone.

Per verdict a cascade encodes the listed keys against the key universe of the
corpus (every candidate key of every url, plus all rules): level 1 holds the
listed keys, level 2 the other keys that pass level 1, level 3 the listed keys
that pass level 2, and so on until a level passes nothing wrong. Membership of
any key of that universe is then exact. Level 1 is built from the rules alone and
probed while keys are exploded, so keys that fail it are never shuffled. A url no
listed key fits gets the method's verdict, `allow`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, lower_ascii, mix, read

#: Bytes of cascades that executors hold at once, about; larger ones are cut into parts by key hash, each a pass over the urls.
MAX_FILTER_BYTES = 64 << 20
LEVELS = 64

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@dataclass
class Level:
    bits: int
    probes: int
    words: np.ndarray


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = lower_ascii(F.regexp_extract(url, pattern, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """array<struct<host, path>> of a url's keys, the longest first, then the longer host."""
    parts = F.split(host, r"\.")
    made = []
    for n in labels:
        suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
        for m in lengths:
            start = F.substring(path, 1, m)
            fits = (F.size(parts) >= n) & (F.length(path) >= m)
            key = F.struct(
                (-(F.length(suffix) + m)).alias("order"), (-F.length(suffix)).alias("wide"), suffix.alias("host"), start.alias("path")
            )
            made.append(F.when(fits, key))
    return F.array_sort(F.array_compact(F.array(*made)))


def key_hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), host, path), F.xxhash64(F.lit(2), path, host)


def _places(number: int, bits: int, probes: int, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bit places of keys, by their 128 bits of hash, in one level; each level mixes them anew."""
    with np.errstate(over="ignore"):
        a = mix(h1 + np.uint64(number * 2 + 1) * np.uint64(0x9E3779B97F4A7C15 >> 8))
        b = mix(h2 ^ (np.uint64(number * 2 + 2) * np.uint64(0xC2B2AE3D27D4EB4F >> 8))) | np.uint64(1)
        return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(probes)]


def probe(level: Level, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys pass one level."""
    passed = np.ones(len(h1), bool)
    for at in _places(number, level.bits, level.probes, h1, h2):
        passed &= (level.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return passed


def member(cascade: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe: a key stops at the first level it fails; odd levels hold listed keys."""
    listed = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for number, level in enumerate(cascade, 1):
        passed = probe(level, number, h1[open_], h2[open_])
        listed[open_[~passed]] = number % 2 == 0
        open_ = open_[passed]
        if not len(open_):
            return listed
    listed[open_] = len(cascade) % 2 == 1
    return listed


def _level(keys: DataFrame, number: int, count: int, false_rate: float) -> Level:
    """Encode ``keys`` (h1, h2): tasks emit bit places, words are or-ed together before they reach the driver."""
    bits = max(64, -(-math.ceil(1.44 * count * math.log2(1 / false_rate)) // 64) * 64)
    probes = max(1, round(bits / count * math.log(2)))

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            at = np.unique(np.concatenate(_places(number, bits, probes, h1, h2)))
            word, mask = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else []
            if len(word):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[firsts]), pa.array(np.bitwise_or.reduceat(mask, firsts).view(np.int64))], ["word", "mask"]
                )

    got = keys.select("h1", "h2").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros(bits // 64, np.uint64)
    for row in got.toLocalIterator():
        table[row["word"]] = np.uint64(row["mask"] & ((1 << 64) - 1))
    return Level(bits, probes, table)


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield batch.filter(pa.array(probe(level, number, h1, h2)))

    return keys.mapInArrow(keep, keys.schema)


def build_cascade(first: Level, listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels from ``first``, which holds ``listed``, on that tell it from ``others``, of which those that ``first`` stops may be left out."""
    cascade = [first]
    held, against = listed, others
    for number in range(1, LEVELS + 1):
        wrong = cut(_passing(against, cascade[-1], number))
        count = wrong.count()
        if not count:
            return cascade
        cascade.append(_level(wrong, number + 1, count, 0.5))
        held, against = wrong, held
    raise RuntimeError("keys of listed and unlisted rules have equal hashes")


def _any_passing(keys: DataFrame, firsts: list[Level]) -> DataFrame:
    """Those of ``keys`` (h1, h2) that pass one of some first levels."""
    held = keys.sparkSession.sparkContext.broadcast(firsts)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            passed = np.zeros(len(h1), bool)
            for level in held.value:
                passed |= probe(level, 1, h1, h2)
            yield batch.filter(pa.array(passed))

    return keys.mapInArrow(keep, keys.schema)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", limit: int = MAX_FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (each replaced if there already).

    ``rules``: host, path, verdict (block or allow), of which equal (host, path)
    count once, as block if they differ. Null urls and urls without `://` have an
    empty host and path; no rule fits them. No rules or pages: `allow` or no rows.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    shapes = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    base = pages.withColumns({"__host": host, "__path": path})
    out = [F.col("__host").alias("host"), F.col("__path").alias("path")]
    if not shapes["labels"]:
        return base.select(*kept, *out, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    found = base.withColumn("__keys", candidate_keys(F.col("__host"), F.col("__path"), sorted(shapes["labels"]), sorted(shapes["lengths"])))
    hashed = [F.transform("__keys", lambda k: key_hashes(k["host"], k["path"])[0]).alias("__h1"), F.transform("__keys", lambda k: key_hashes(k["host"], k["path"])[1]).alias("__h2")]
    found = found.select("*", *hashed).withColumn("__best", F.lit(0).cast("long"))
    keys = found.select(F.explode(F.arrays_zip("__h1", "__h2")).alias("k")).select(F.col("k.__h1").alias("h1"), F.col("k.__h2").alias("h2"))
    universe = keys.agg(F.approx_count_distinct("h1")).first()[0]
    h1, h2 = key_hashes(F.col("host"), F.col("path"))
    listed = cut(rules.select(h1.alias("h1"), h2.alias("h2"), "verdict"))
    total = {r["verdict"]: r["n"] for r in listed.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    rates = {v: min(0.5, max(1e-6, 0.7 * n / max(universe, 1))) for v, n in total.items()}
    parts = max(1, math.ceil(sum(1.44 * n * (math.log2(1 / rates[v]) + 4) for v, n in total.items()) / 8 / max(limit, 1)))

    def of(part: int, rows: DataFrame) -> DataFrame:
        return rows.filter(F.pmod(F.shiftright("h1", 32), F.lit(parts)) == part) if parts > 1 else rows

    for part in range(parts):
        mine = of(part, listed)
        sizes = {r["verdict"]: r["n"] for r in mine.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            continue
        firsts = {v: _level(mine.filter(F.col("verdict") == v), 1, n, rates[v]) for v, n in sizes.items()}
        passing = _any_passing(of(part, keys), list(firsts.values())).distinct().withColumn("verdict", F.lit(None).cast("string"))
        marked = cut(passing.union(mine).groupBy("h1", "h2").agg(F.max("verdict").alias("verdict")))
        cascades = {
            v: build_cascade(first, mine.filter(F.col("verdict") == v).select("h1", "h2"), marked.filter(F.col("verdict").isNull() | (F.col("verdict") != v)).select("h1", "h2"))
            for v, first in firsts.items()
        }
        found = found.withColumn("__best", _looked_up(found, cascades, part, parts))
        if parts > 1:
            found = cut(found)
    at = "int(shiftright(__best, 2)) - 1"
    rule = F.when(F.col("__best") > 0, F.expr(f"concat(__keys[{at}].host, __keys[{at}].path)"))
    verdict = F.when(F.col("__best").bitwiseAND(3) == 1, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(*kept, *out, rule.alias("rule"), verdict.alias("verdict"))


def _looked_up(found: DataFrame, cascades: dict[str, list[Level]], part: int, parts: int) -> Column:
    """(place + 1) * 4 + 1 for block or 2 for allow of the first key of __h1, __h2 that is listed in one part or, by __best, in those before; else 0."""
    held = found.sparkSession.sparkContext.broadcast(cascades)

    def choose(h1: pd.Series, h2: pd.Series, known: pd.Series) -> pd.Series:
        cascades = held.value
        count = np.fromiter((len(x) for x in h1), np.int64, len(h1))
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (h1, h2))
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        mine = np.flatnonzero((a >> 32) % parts == part)
        a, b, row, place = (x[mine] for x in (a, b, row, place))
        a, b = a.view(np.uint64), b.view(np.uint64)
        code = np.zeros(len(a), np.int64)
        for verdict, mark in (("allow", 2), ("block", 1)):
            if verdict in cascades:
                code[member(cascades[verdict], a, b)] = mark
        best = np.zeros(len(count), np.int64)
        hits = np.flatnonzero(code)[::-1]  # the first key of a row is written last
        best[row[hits]] = (place[hits] + 1) * 4 + code[hits]
        before = known.to_numpy()
        return pd.Series(np.where((best == 0) | ((before > 0) & (before < best)), before, best))

    return F.pandas_udf(choose, "long")(F.col("__h1"), F.col("__h2"), F.col("__best"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS n
  FROM parts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON p.page_id = f.page_id
"""
