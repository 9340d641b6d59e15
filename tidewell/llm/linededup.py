"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is its lines. Fingerprints of a document are

* every line of at least HEAVY words, and
* of each WINDOW pairs of neighbouring lines the pair with the smallest hash
  (blank lines left out).

So two documents that share a run of lines of more than MIN_WORDS words share a
fingerprint in it: the run has a heavy line, or at least WINDOW + 1 lines. Each
fingerprint's later occurrences are joined to its first one (by doc_id, then
line), the match is extended both ways while lines are equal, and runs of at
least MIN_WORDS words are deleted where they come later.

A line that repeats at once, again and again, would match itself at every shift. Of
a stretch of equal lines only as many at both ends are kept for matching as hold
MIN_WORDS words, which lose no match: what a match needs of a stretch it finds at
one of its ends. Within a stretch the lines after the first match those before
them, and no other shift is tried.

A fingerprint may come first in a document that shares less around it than
another does. Documents that the fingerprints join are therefore joined once
more, by the hashes of their shortest runs of MIN_WORDS words from each line on
and up to each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.llm.common import cut, join_salted, read

HEAVY = 13
WINDOW = 3
#: A repeated run is deleted if it has so many words: four lines of under HEAVY words have fewer.
MIN_WORDS = 50
#: Alignments to one document that a task extends, about.
MEETINGS = 2000
#: Keys of documents with runs up to this number are sent to all executors; beyond it a join shuffles texts.
MAX_KEYS = 1_000_000


def _parsed(text: Column) -> Column:
    """array<struct<h, w, at>> of the lines that aren't blank: hash without white space at the ends, words, line number."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.trim(F.translate(x, "\t\r", "  ")).alias("x"), i.alias("at")))
    lines = F.filter(lines, lambda s: s["x"] != "")
    return F.transform(
        lines, lambda s: F.struct(F.xxhash64(s["x"]).alias("h"), F.regexp_count(s["x"], F.lit("[^ ]+")).alias("w"), s["at"].alias("at"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key: doc_id, or where some rows have none or one that repeats (none?, doc_id, row number).

    The rows are then numbered in a copy, so that all reads of them agree; those
    without doc_id come last.
    """
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("__key", F.col("doc_id"))
    rows = cut(docs.withColumn("__no", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "__no")
    return rows.withColumn("__key", key).drop("__no")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line, words, of_doc, of_line): later occurrences of repeated runs, lines from 0.

    Blank lines neither match nor break a run. A run may repeat one in the same
    document that begins earlier. Each row is a document of its own: of rows with
    equal doc_id one counts as the earlier, and rows without doc_id are later than
    all with one. Null and empty texts have no lines that repeat.
    """
    keyed = _keyed(docs.select("doc_id", "text")).select(F.col("__key").alias("doc_id"), "text")
    return _named(_runs(keyed, min_words))


def _named(runs: DataFrame) -> DataFrame:
    """``runs`` with doc_id and of_doc as they were before they were made keys."""
    if not isinstance(runs.schema["doc_id"].dataType, StructType):
        return runs
    return runs.withColumns({c: F.when(~F.col(c)["none"], F.col(c)["id"]) for c in ("doc_id", "of_doc")})


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """repeated_runs of documents whose doc_id is a key that doesn't repeat."""
    parsed = docs.filter("text is not null").select("doc_id", _parsed(F.col("text")).alias("x"))
    table = cut(_shortened(parsed.select("doc_id", F.col("x.h").alias("h"), F.col("x.w").alias("w"), F.col("x.at").alias("line")), min_words))
    none = "cast(array() as array<bigint>)"
    pairs = table.withColumn("p", F.expr(f"if(size(h) > 1, transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1])), {none})"))
    lowest = f"int(array_position(slice(p, i + 1, {WINDOW}), array_min(slice(p, i + 1, {WINDOW})))) + i - 1"
    chosen = f"array_distinct(transform(sequence(0, greatest(size(p) - {WINDOW}, 0)), i -> {lowest}))"
    light = F.expr(f"if(size(p) > 0, transform({chosen}, i -> struct(p[i] as f, i as at, s[i] as s)), cast(array() as array<struct<f: bigint, at: int, s: int>>))")
    heavy = F.expr(f"filter(transform(h, (x, i) -> struct(xxhash64(x, 1) as f, i as at, s[i] as s)), x -> w[x.at] >= {HEAVY})")
    prints = pairs.select("doc_id", F.explode(F.concat(light, heavy)).alias("x")).select("doc_id", "x.f", "x.at", "x.s")
    met = cut(_extended(table, _joined(prints)))
    again = met.select("doc_id").union(met.select("of_doc")).distinct()
    # the lines of the shortest run from line i on, and of the shortest up to it; 0 where there is none
    total = f"struct(0 as n, 0 as t), (a, x) -> struct(if(a.t < {min_words}, a.n + 1, a.n) as n, int(a.t + x) as t), a -> if(a.t < {min_words}, 0, a.n)"
    onward = f"aggregate(slice(w, i + 1, {min_words}), {total})"
    upward = f"aggregate(reverse(slice(w, greatest(i + 2 - {min_words}, 1), least(i + 1, {min_words}))), {total})"
    each = "transform(sequence(0, size(w) - 1), i -> {})"
    spans = F.expr(
        f"filter(array_distinct(concat({each.format(f'struct(i as at, {onward} as n)')}, "
        f"transform({each.format(f'struct(i as at, {upward} as n)')}, x -> struct(x.at - x.n + 1 as at, x.n as n)))), x -> x.n > 0)"
    )
    runs = table.filter("size(w) > 0").join(again, "doc_id", "left_semi").withColumn("spans", spans)
    # a run that lies in one stretch is told by it, so that such runs don't meet at every shift
    whole = F.explode(F.expr("transform(spans, x -> struct(xxhash64(slice(h, x.at + 1, x.n)) as f, x.at as at, if(s[x.at] = s[x.at + x.n - 1], s[x.at], -1 - x.at) as s))"))
    second = _joined(runs.select("doc_id", whole.alias("x")).select("doc_id", "x.f", "x.at", "x.s"))
    second = second.join(met, ["doc_id", "of_doc", "shift"], "left_anti")
    both = met.unionByName(_extended(table, second)).select("doc_id", "of_doc", F.explode("runs").alias("run"))
    return both.filter(F.col("run.words") >= min_words).select(
        "doc_id", *(F.col(f"run.{c}").alias(c) for c in ("first_line", "last_line", "words")), "of_doc", "run.of_line"
    )


def _shortened(table: DataFrame, min_words: int) -> DataFrame:
    """``table`` (doc_id, h, w, line) with the middle of long stretches of equal lines left out.

    Adds s, where each line's stretch begins, and all_w, the words of each line
    with those of lines left out before it. At each end stay as many lines as
    have ``min_words`` words, at the first end one more: that which repeats first.
    """
    # each step is bound to a name once: an array taken from another in a lambda is made again for every element
    steps = [
        ("t", "struct(h, w, line)"),
        ("b", "filter(sequence(0, size(t.h)), i -> i = 0 or i = size(t.h) or t.h[i] != t.h[i - 1])"),
        ("r", f"transform(slice(b, 1, greatest(size(b) - 1, 0)), (x, j) -> struct(x as lo, b[j + 1] as hi, int(ceil({min_words} / t.w[x])) as e))"),
        ("k", "flatten(transform(r, x -> if(x.hi - x.lo > 2 * x.e + 1, concat(sequence(x.lo, x.lo + x.e), sequence(x.hi - x.e, x.hi - 1)), sequence(x.lo, x.hi - 1))))"),
    ]
    told = "struct(" + ", ".join(f"transform(k, x -> t.{c}[x]) as {c}" for c in ("h", "w", "line"))
    told += ", flatten(transform(r, x -> array_repeat(x.lo, int(least(x.hi - x.lo, 2 * x.e + 1))))) as s"
    told += ", transform(k, (x, i) -> if(i = 0, t.w[x], t.w[x] * (x - k[i - 1]))) as all_w)"
    for name, value in reversed(steps):
        told = f"transform(array({value}), {name} -> {told})[0]"
    some = table.filter("size(h) > 0").select("doc_id", F.expr(told).alias("z"))
    return some.select("doc_id", "z.h", "z.w", "z.line", "z.s", "z.all_w")


def _joined(prints: DataFrame) -> DataFrame:
    """(doc_id, of_doc, shift): alignments of later occurrences of fingerprints (doc_id, f, at, s) to the first one, within a stretch those of neighbours alone."""
    firsts = prints.groupBy("f").agg(F.min(F.struct("doc_id", "at", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = prints.join(firsts.select("f", "first"), "f")
    inside = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("s") == F.col("first.s"))
    return (
        met.select("doc_id", F.col("first.doc_id").alias("of_doc"), F.when(inside, F.sign(F.col("first.at") - F.col("at")).cast("int")).otherwise(F.col("first.at") - F.col("at")).alias("shift"))
        .filter("doc_id > of_doc or (doc_id = of_doc and shift < 0)")
        .distinct()
    )


def _extended(table: DataFrame, shifts: DataFrame) -> DataFrame:
    """``shifts`` with ``runs``: the runs of lines that are equal at the shift, with their words.

    A document that more than MEETINGS others are aligned to is copied to salts.
    """
    source = table.select(F.col("doc_id").alias("of_doc"), F.col("h").alias("g"), F.col("line").alias("of_line"))
    equal = F.expr("filter(sequence(greatest(0, -shift), least(size(h), size(g) - shift) - 1), i -> h[i] = g[i + shift])")
    met = join_salted(cut(shifts), source, ["of_doc"], MEETINGS).join(table, "doc_id").withColumn("m", equal)
    # a line of a run starts it unless the line before it is equal too
    starts = F.expr("filter(m, (x, i) -> i = 0 or m[i - 1] != x - 1)")
    ends = F.expr("filter(m, (x, i) -> i = size(m) - 1 or m[i + 1] != x + 1)")
    runs = F.expr(
        "transform(r, x -> struct(line[x.s] as first_line, line[x.e] as last_line, "
        "aggregate(slice(all_w, x.s + 2, x.e - x.s), bigint(w[x.s]), (a, b) -> a + b) as words, of_line[x.s + shift] as of_line))"
    )
    return met.withColumn("r", F.arrays_zip(starts.alias("s"), ends.alias("e"))).select(*shifts.columns, runs.alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, gone: bool = False) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from text and n_chars (if there) set anew.

    All other columns stay as they are. A document of which nothing but blank
    lines is left has text ''; with ``gone`` it is dropped, unless it had none before.
    Shorter repeated runs stay, and so do passages that repeat within longer lines.
    """
    keyed = _keyed(docs)
    out = _without(keyed, _runs(keyed.select(F.col("__key").alias("doc_id"), "text"), min_words))
    if gone:
        out = out.filter("__runs is null or __text != ''")
    sized = {"n_chars": F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": F.col("__text")} | sized).select(*docs.columns)


def _without(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """``keyed`` with __runs, the runs of each document (null: none), and __text, its text without them."""
    runs = runs.groupBy(F.col("doc_id").alias("__key")).agg(F.collect_set(F.struct("first_line", "last_line")).alias("__runs"))
    # runs grow with the documents: they are joined alike at every size
    met = keyed.join(runs.hint("merge"), "__key", "left")
    left = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not exists(__runs, r -> i between r.first_line and r.last_line)), '\\n')")
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.when(F.trim(F.translate(left, "\n\t\r", "   ")) == "", F.lit("")).otherwise(left))
    return met.withColumn("__text", text)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs deleted from all documents: lines first_line to last_line of doc_id, which repeat of_doc from of_line on.

    ``left_chars`` and ``left_crc32`` are of the document's text without all its
    runs; documents that lose nothing have no row.
    """
    keyed = _keyed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = cut(_runs(keyed.select(F.col("__key").alias("doc_id"), "text"), MIN_WORDS))
    named = cut(runs.select("doc_id").distinct().withColumnRenamed("doc_id", "__key"))
    few = F.broadcast(named) if named.count() <= MAX_KEYS else named
    cleaned = _without(keyed.join(few, "__key", "left_semi"), runs)
    left = cleaned.select(F.col("__key").alias("doc_id"), F.length("__text").cast("long").alias("left_chars"), F.crc32("__text").alias("left_crc32"))
    lines = [F.col(c).cast("long").alias(c) for c in ("first_line", "last_line", "words")]
    return _named(runs.join(left, "doc_id")).select("doc_id", *lines, "of_doc", F.col("of_line").cast("long"), "left_chars", "left_crc32")
