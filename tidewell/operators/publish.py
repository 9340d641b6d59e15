"""Published pages: rankings, keyword indexes, coverage, weekly landscape and heat shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.maths import half_up


def community_ranking(items: DataFrame, least: int) -> DataFrame:
    """Posts and reactions per source; the category with the most posts, the earliest seen of equal ones."""
    tops = items.groupBy("source", "category").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    top = tops.groupBy("source").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("top_category"))
    sums = items.groupBy("source").agg(F.count("*").alias("posts"), F.sum("score").alias("score"), F.sum("comment_count").alias("comments"))
    out = sums.filter(F.col("posts") >= least).join(top, "source")
    return out.select(
        "source", "posts", "score", "comments", (F.col("score") + F.col("comments")).alias("reactions"), half_up(F.col("comments") / F.col("posts")).alias("avg_comments"), "top_category"
    ).orderBy(F.desc("reactions"), F.desc("posts"))


def best_of(items: DataFrame, n: int) -> DataFrame:
    """The n items with most reactions, a top-n without a global sort."""
    return items.withColumn("reactions", F.col("score") + F.col("comment_count")).orderBy(F.desc("reactions"), "ord").limit(n)


def keyword_index(items: DataFrame, n: int, sources: int = 2, least: int = 3) -> DataFrame:
    """Tags that several sources use, by reactions."""
    tagged = items.select(F.explode("tags").alias("tag"), "source", (F.col("score") + F.col("comment_count")).alias("r"))
    rows = tagged.groupBy("tag").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.sum("r").alias("reactions"))
    return rows.filter((F.col("sources") >= sources) & (F.col("items") >= least)).orderBy(F.desc("reactions"), F.desc("items"), "tag").limit(n)


def first_of_key(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key by arrival; rows without one all stay. First places are aggregated, not windowed."""
    keyed = rows.filter(F.col(key).isNotNull())
    return keyed.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), "ord").alias("r")).select("r.*").unionByName(rows.filter(F.col(key).isNull()))


def coverage(rows: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Distinct sources of each event key, of two at least, capped."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("source").alias("n"))
    return counts.filter("n >= 2").select(key, F.least(F.lit(most), F.col("n")).cast("long").alias("coverage"))


def related(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(id, related): the first items of other sources with the same event key, one a source.

    Of a key only each source's first items matter, most + 1 sources of them, so a
    key that many rows share is cut down before the join.
    """
    keyed = rows.filter(F.col(key).isNotNull())
    heads = keyed.groupBy(key, "source").agg(F.min_by("id", "ord").alias("related"), F.min("ord").alias("at"))
    by = Window.partitionBy(key).orderBy("at")
    heads = heads.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most + 1)
    met = keyed.select("id", key, F.col("source").alias("own")).join(heads, key).filter("own != source")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter(F.col("r") <= most).select("id", "related")


def landscape(rows: DataFrame, group: str, days: int) -> DataFrame:
    """Showings of each group over the last editions, its days, and its gain from their first half to the last; an odd middle day counts for neither."""
    editions = rows.select("day").distinct().orderBy(F.desc("day")).limit(days)
    ranked = editions.withColumn("back", F.row_number().over(Window.orderBy(F.desc("day")))).withColumn("all", F.count("*").over(Window.partitionBy()))
    met = rows.join(F.broadcast(ranked), "day")
    half = F.floor(F.col("all") / 2)
    gain = F.count_if(F.col("back") <= half) - F.count_if(F.col("back") > F.col("all") - half)
    return met.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"), gain.alias("mover"))


def last_samples(rows: DataFrame, key: str, ord_: str, value: str, n: int) -> DataFrame:
    """(key, h): each key's last n values in order; the window drops earlier ones before they are gathered."""
    by = Window.partitionBy(key).orderBy(F.desc(ord_))
    last = rows.withColumn("__r", F.row_number().over(by)).filter(F.col("__r") <= n)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(value).alias("v"))))
    return last.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("h"))


def steps(h: Column) -> Column:
    return F.when(F.size(h) > 1, F.zip_with(F.slice(h, 2, F.size(h)), F.slice(h, 1, F.size(h) - 1), lambda a, b: a - b)).otherwise(F.slice(h, 1, 0))


def running_sums(h: Column) -> Column:
    return F.transform(h, lambda _, i: F.aggregate(F.slice(h, 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))


def scaled(h: Column) -> Column:
    """Values between 0 and 1 by least and greatest, two digits; 0.15 where flat."""
    low, high = F.array_min(h), F.array_max(h)
    return F.transform(h, lambda x: F.when(high == low, F.lit(0.15)).otherwise(half_up((x - low) / (high - low), 2)))


def heat_shapes(rows: DataFrame, group: str, least: int = 5, rise: int = 30, members: int = 5) -> DataFrame:
    """Mean share of the rise in the first half of the steps, per group; series that ever fall or hardly rise don't count."""
    d = steps(F.col("h"))
    grown = rows.filter(F.size("h") >= least).withColumn("d", d).filter(F.forall("d", lambda x: x >= 0))
    total = F.aggregate("d", F.lit(0).cast("long"), lambda a, b: a + b)
    front = F.aggregate(F.slice("d", 1, F.ceil(F.size("d") / 2).cast("int")), F.lit(0).cast("long"), lambda a, b: a + b)
    shares = grown.withColumn("t", total).filter(F.col("t") >= rise).withColumn("front_pct", half_up(100 * front / F.col("t")))
    return shares.groupBy(group).agg(F.avg("front_pct").alias("front_pct"), F.count("*").alias("n")).filter(F.col("n") >= members)


def editorial_flags(items: DataFrame) -> DataFrame:
    """Outlier (three times its source's mean), debate (comments far over score) or plain."""
    rows = items.withColumn("eng", F.col("score") + 2 * F.col("comment_count"))
    means = rows.groupBy("source").agg(F.avg("eng").alias("mean"), F.count("*").alias("n"))
    flag = F.when((F.col("n") >= 2) & (F.col("eng") >= 3 * F.col("mean")), "outlier").when((F.col("comment_count") >= 30) & (F.col("comment_count") >= 3 * F.col("score")), "debate")
    return rows.join(means, "source").withColumn("flag", flag.otherwise("plain"))


def keyword_rows(items: DataFrame, tag: str, least: int = 3) -> DataFrame:
    """Items with a tag; where none has it, those whose title holds it in any case, if it has ``least`` characters."""
    own = items.filter(F.array_contains("tags", tag))
    if not own.isEmpty() or len(tag.strip()) < least:
        return own
    return items.filter(F.lower("title").contains(tag.strip().lower()))


def page_parts(items: DataFrame, n: int, *histograms: str) -> DataFrame:
    """(what, key, n) of a page: its n best items by reactions, its histograms without nulls, and how many items there are."""
    best = best_of(items, n).select(F.lit("item").alias("what"), F.col("id").cast("string").alias("key"), F.col("reactions").cast("long").alias("n"))
    for h in histograms:
        best = best.union(items.filter(F.col(h).isNotNull()).groupBy(h).agg(F.count("*").alias("n")).select(F.lit(h), h, "n"))
    return best.union(items.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit(""), "n"))


def rank_band(place: Column) -> Column:
    return F.when(place <= 5, "1-5").when(place <= 10, "6-10").when(place <= 20, "11-20")


def period_top(rows: DataFrame, editions: int, per_source: int, n: int) -> DataFrame:
    """(story, source, hot, place, band) of the latest ``editions`` days: each story's best showing, ``per_source`` of a source, the n hottest."""
    from tidewell.operators.hot import capped_top

    days = rows.select("day").distinct().orderBy(F.desc("day")).limit(editions)
    best = rows.join(F.broadcast(days), "day", "left_semi").groupBy("story").agg(F.max(F.struct("hot", (-F.col("ord")).alias("o"), "source")).alias("s"))
    order = (F.desc("hot"), F.asc("story"))
    top = capped_top(best.select("story", "s.source", "s.hot"), per_source, n, order=order)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.withColumn("place", place).withColumn("band", rank_band(F.col("place")))


def briefing_weight(traffic: Column, strength: Column, weighty: Column) -> Column:
    """Reactions, 50 a source of coverage, up to 250 for what is searched for, and 105 for weighty categories."""
    return F.col("score") + 2 * F.col("comment_count") + 50 * F.col("coverage") + 250 * F.least(F.lit(1.0), traffic / 1000) * strength + F.when(weighty, 105).otherwise(0)


def editorial_notes(items: DataFrame, now: Column, multiple: float = 3.0) -> DataFrame:
    """``items`` (with source_rank and translated) with the first note that holds.

    surge: within a day, 300 likes or comments. outlier: so many times the source's
    mean likes. first: top of its source with any reaction. debate: 30 comments and
    three for each like. fresh: within half an hour with any reaction. translated,
    coverage by three, top three within half an hour; else none.
    """
    from tidewell.operators.hot import hours_between

    means = items.groupBy("source").agg(F.avg("score").alias("__mean"), F.count("*").alias("__n"))
    rows = items.join(means, "source")
    age = hours_between(now, F.col("published_at")) * 60
    minutes = F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))
    s, c, any_ = F.col("score"), F.col("comment_count"), (F.col("score") > 0) | (F.col("comment_count") > 0)
    note = (
        F.when((minutes <= 1440) & ((s >= 300) | (c >= 300)), "surge")
        .when((F.col("__mean") > 0) & (F.col("__n") >= 2) & (s > 0) & (s >= multiple * F.col("__mean")), "outlier")
        .when((F.col("source_rank") == 0) & any_, "first")
        .when((c >= 30) & (c >= 3 * s), "debate")
        .when((minutes <= 30) & any_, "fresh")
        .when(F.col("translated") & (F.coalesce("summary", F.lit("")) != ""), "translated")
        .when(F.col("coverage") >= 3, "coverage")
        .when((F.col("source_rank") <= 2) & (minutes <= 30), "top")
    )
    return rows.withColumn("note", F.coalesce(note, F.lit("none"))).drop("__mean", "__n")


def issue_subjects(members: DataFrame, by: list[str], least: int = 2, most: int = 2) -> DataFrame:
    """(by, subject): the words that most titles of an issue (title, place) share, those of two titles at least; where there are none, the first phrase of its first title.

    Words of two characters and more count once a title; equal ones go by where
    they stand first.
    """
    from tidewell.functions.text import lead_phrase

    words = members.select(*by, "place", F.posexplode(F.split("title", "[^가-힣a-zA-Z0-9]+")).alias("at", "w")).filter(F.length("w") >= 2)
    once = words.groupBy(*by, "place", "w").agg(F.min("at").alias("at"))
    counts = once.groupBy(*by, "w").agg(F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("first")).filter(F.col("n") >= least)
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).filter(F.col("r") <= most)
    shared = top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), " ").alias("s"))
    lead = members.filter("place = 0").select(*by, lead_phrase(F.col("title")).alias("lead"))
    return lead.join(shared, by, "left").select(*by, F.coalesce("s", "lead").alias("subject"))


#: How excerpts begin that say nothing of their page.
FILLER = "^(직접 눌러|자세한 내용은|내용을 확인|클릭하여|더 보기)"


def own_summaries(rows: DataFrame, least: int = 20, most: int = 200) -> DataFrame:
    """A published list with ``summary`` cut at ``most`` and blank where it isn't the item's own: under ``least`` characters, met twice in the list, or filler."""
    rows = rows.withColumn("summary", F.substring(F.coalesce("summary", F.lit("")), 1, most)).withColumn("__k", F.trim("summary"))
    times = rows.filter("__k != ''").groupBy("__k").agg(F.count("*").alias("__times"))
    own = (F.length("__k") >= least) & (F.coalesce("__times", F.lit(1)) == 1) & ~F.col("__k").rlike(FILLER)
    return rows.join(times, "__k", "left").withColumn("summary", F.when(own, F.col("summary")).otherwise("")).drop("__k", "__times")
