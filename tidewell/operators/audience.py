"""Product analytics: day metrics, roll-ups, unique visitors, dimensions, ads, costs and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.dates import month_key, week_key
from tidewell.functions.maths import half_up, safe_ratio, shrunk_rate

#: Longer stays are tabs left open and not reading.
MAX_DWELL_MS = 2 * 3600 * 1000
MAX_DEPTH = 2000
MAX_KEYS = 120
OTHER = "기타"


def metrics(events: DataFrame, *by: str) -> DataFrame:
    """Counts of track events (type, entry, dwell_ms, depth, user_id) per group; unknown values don't count.

    Sums combine before the shuffle; distinct visitors are exact, counted over
    the distinct pairs of group and visitor.
    """
    kind = F.col("type")
    dwell = (kind == "exit") & (F.col("dwell_ms") > 0) & (F.col("dwell_ms") <= MAX_DWELL_MS)
    depth = (kind == "exit") & (F.col("depth") >= 0) & (F.col("depth") <= MAX_DEPTH)
    return events.groupBy(*by).agg(
        F.count_if(kind == "view").alias("pv"),
        F.count_if((kind == "view") & F.col("entry")).alias("sessions"),
        F.countDistinct("user_id").alias("visitors"),
        F.coalesce(F.sum(F.when(dwell, F.col("dwell_ms"))), F.lit(0)).cast("long").alias("dwell_ms"),
        F.count_if(dwell).alias("dwell_n"),
        F.coalesce(F.sum(F.when(depth, F.col("depth"))), F.lit(0)).cast("long").alias("depth"),
        F.count_if(depth).alias("depth_n"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "ad_impression").alias("ad_imp"),
        F.count_if(kind == "ad_click").alias("ad_click"),
    )


def summaries(rows: DataFrame) -> DataFrame:
    """Averages and rates of metrics; null where nothing was measured, not 0."""
    return rows.withColumns(
        {
            "pv_per_visitor": half_up(safe_ratio(F.col("pv"), F.col("visitors")), 1),
            "avg_dwell_s": half_up(safe_ratio(F.col("dwell_ms"), F.col("dwell_n")) / 1000),
            "avg_depth": half_up(safe_ratio(F.col("depth"), F.col("depth_n")), 1),
            "ctr": half_up(safe_ratio(F.col("ad_click"), F.col("ad_imp")), 4),
        }
    )


def period(day: Column, grain: str) -> Column:
    return {"day": day, "week": week_key(day), "month": month_key(day)}[grain]


def new_and_returning(events: DataFrame) -> DataFrame:
    """(day, visitors, new, returning): a visitor is new on the first day they are seen."""
    daily = events.select("user_id", "day").distinct()
    first = daily.groupBy("user_id").agg(F.min("day").alias("first"))
    counts = daily.join(first, "user_id").groupBy("day").agg(F.count("*").alias("visitors"), F.count_if(F.col("day") == F.col("first")).alias("new"))
    return counts.withColumn("returning", F.greatest(F.lit(0), F.col("visitors") - F.col("new")))


def dimension_counts(events: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dim, key, n) of several dimensions in one pass; null and empty keys don't count."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), c.cast("string").alias("key")) for n, c in dims.items()])
    return events.select(F.explode(pairs).alias("p")).select("p.dim", "p.key").filter("key is not null and key != ''").groupBy("dim", "key").agg(F.count("*").alias("n"))


def top_keys(counts: DataFrame, n: int) -> DataFrame:
    """The n largest keys of each dimension, equal ones by key."""
    by = Window.partitionBy("dim").orderBy(F.desc("n"), "key")
    return counts.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n)


def fold_keys(events: DataFrame, key: str, ord_: str, most: int = MAX_KEYS) -> DataFrame:
    """(key, n): the keys that came first, at most ``most``; later ones count under one name.

    First arrivals are aggregated per key, so only keys are ranked and not events.
    """
    keys = events.groupBy(key).agg(F.min(ord_).alias("first"), F.count("*").alias("n"))
    kept = keys.orderBy("first").limit(most).select(key, F.lit(True).alias("kept"))
    named = keys.join(kept, key, "left").withColumn("key", F.when(F.col("kept"), F.col(key)).otherwise(OTHER))
    return named.groupBy("key").agg(F.sum("n").alias("n"))


def rank_decade(rank: Column) -> Column:
    """Ranks from 0 in tens: 1~10, 11~20, ..."""
    base = F.floor(rank / 10) * 10
    return F.when(rank >= 0, F.concat((base + 1).cast("string"), F.lit("~"), (base + 10).cast("string")))


def ad_slots(ads: DataFrame) -> DataFrame:
    """(slot, imp, click, ctr in percent), most impressions first."""
    rows = ads.groupBy("slot").agg(F.count_if(F.col("type") == "ad_impression").alias("imp"), F.count_if(F.col("type") == "ad_click").alias("click"))
    return rows.withColumn("ctr", half_up(100 * safe_ratio(F.col("click"), F.col("imp")), 2)).orderBy(F.desc("imp"), "slot")


def variant_scores(ads: DataFrame, weight: float = 30.0) -> DataFrame:
    """Variants with their click rate and its shrinkage to the rate of all."""
    rows = ads.groupBy("variant").agg(F.count_if(F.col("type") == "ad_impression").alias("imp"), F.count_if(F.col("type") == "ad_click").alias("click"))
    total = rows.agg((F.sum("click") / F.sum("imp")).alias("base"))
    shrunk = shrunk_rate(F.col("click"), F.col("imp"), F.col("base"), weight)
    return rows.join(F.broadcast(total)).withColumns({"ctr": safe_ratio(F.col("click"), F.col("imp")), "score": shrunk}).drop("base")


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens, dollars and unpriced calls by day, day and model, day and purpose, in one pass.

    A model without a price costs null and counts as unpriced. Prices are dollars a
    million tokens in exact decimals, so sums come out alike in any order.
    """
    exact = "cast(in_tok as decimal(18, 0)) * cast(in_price as decimal(12, 6)) + cast(out_tok as decimal(18, 0)) * cast(out_price as decimal(12, 6))"
    priced = calls.join(prices, "model", "left").withColumn("micro", F.expr(f"cast({exact} as decimal(38, 6))"))
    sets = [["day"], ["day", "model"], ["day", "purpose"]]
    return priced.groupingSets([[F.col(c) for c in s] for s in sets], "day", "model", "purpose").agg(
        F.count("*").alias("calls"),
        F.sum("in_tok").alias("in_tok"),
        F.sum("out_tok").alias("out_tok"),
        F.coalesce(F.sum("micro").cast("double") / 1e6, F.lit(0.0)).alias("usd"),
        F.count_if(F.col("micro").isNull()).alias("unpriced"),
    )


def profit(daily: DataFrame, fixed: DataFrame, revenue: DataFrame, rate: float) -> DataFrame:
    """Per month: variable cost (dollars by a rate), its days' share of fixed costs, revenue and net; net is null without revenue."""
    from tidewell.functions.dates import days_in_month

    days = daily.withColumns({"month": month_key(F.col("day")), "__all": days_in_month(F.col("day"))})
    months = days.groupBy("month").agg(F.sum(F.col("usd").cast("decimal(38, 12)")).cast("double").alias("usd"), (F.count("*") / F.max("__all")).alias("share"))
    fixed = fixed.groupBy("month").agg(F.sum("krw").alias("fixed_krw"))
    met = months.join(fixed, "month", "left").join(revenue, "month", "left")
    out = met.select("month", half_up(F.col("usd") * rate).alias("variable"), half_up(F.coalesce("fixed_krw", F.lit(0)) * F.col("share")).alias("fixed"), "revenue", F.col("fixed_krw").isNull().alias("missing"))
    return out.withColumn("net", F.col("revenue") - F.col("variable") - F.col("fixed"))


def source_health(registry: DataFrame, items: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Verdict per enabled source from its items, those with signal and when either was last seen; a day's grace."""
    sample = items.groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("score") + F.col("comment_count") > 0).alias("with_signal"))
    met = registry.filter("enabled").join(sample, "source", "left").join(state, "source", "left").fillna(0, ["items", "with_signal"])
    fresh = lambda c: F.coalesce(F.col(c) > now - F.expr("interval 24 hours"), F.lit(False))
    status = (
        F.when((F.col("items") == 0) & fresh("last_items"), "stalled")
        .when(F.col("items") == 0, "down")
        .when((F.col("with_signal") > 0) | ~F.col("expects_signal"), "ok")
        .when(F.col("last_signal").isNull(), "no-signal")
        .when(fresh("last_signal"), "ok")
        .otherwise("signal-lost")
    )
    return met.withColumn("status", status)


def trailing_count(rows: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """``rows`` with the number of events of the same key in the ``seconds`` up to each: its own second counts, the one ``seconds`` before doesn't."""
    w = Window.partitionBy(by).orderBy(F.col(ts).cast("long")).rangeBetween(-(seconds - 1), 0)
    return rows.withColumn("trailing", F.count("*").over(w))


def last_distinct(rows: DataFrame, by: str, key: str, n: int, first: bool = False) -> DataFrame:
    """Each reader's n latest distinct keys; a repeated key moves to its last showing, or stays at its first."""
    at = (F.min if first else F.max)("ord").alias("at")
    once = rows.groupBy(by, key).agg(at)
    w = Window.partitionBy(by).orderBy(F.desc("at"))
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def minute_limit(rows: DataFrame, by: str, ts: str, most: int) -> DataFrame:
    """Events that stay within ``most`` of their key and clock minute, in order of arrival."""
    w = Window.partitionBy(by, F.date_trunc("minute", ts)).orderBy(ts, "ord")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


def runs_of_same(rows: DataFrame, by: str, ord_: str, value: str) -> DataFrame:
    """(by, rows, same): rows of each group and those equal to the row before."""
    w = Window.partitionBy(by).orderBy(ord_)
    return rows.withColumn("__same", F.col(value) == F.lag(value).over(w)).groupBy(by).agg(F.count("*").alias("rows"), F.count_if("__same").alias("same"))


# --- mergeable day buckets ---

TOTALS = ["pv", "sessions", "dwell_ms", "dwell_n", "depth", "depth_n", "clicks", "ad_imp", "ad_click"]


def day_buckets(events: DataFrame, dims: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is kept of a day: its totals (day, ...), its keys (day, dim, key, n) and its visitors (day, user_id, new).

    Totals and keys add up and visitors unite, so weeks and months come from the
    buckets of their days without an event being read again.
    """
    totals = metrics(events, "day").select("day", *TOTALS)
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), c.cast("string").alias("key")) for n, c in dims.items()])
    keys = events.select("day", F.explode(pairs).alias("p")).select("day", "p.*").filter("key is not null and key != ''").groupBy("day", "dim", "key").agg(F.count("*").alias("n"))
    seen = events.select("day", "user_id").distinct()
    first = seen.groupBy("user_id").agg(F.min("day").alias("first"))
    visitors = seen.join(first, "user_id").select("day", "user_id", (F.col("day") == F.col("first")).alias("new"))
    return totals, keys, visitors


def merged_totals(totals: DataFrame, visitors: DataFrame, grain: str) -> DataFrame:
    """Totals of days, weeks or months from day buckets: sums, and visitors each counted once."""
    own = totals.withColumn("period", period(F.col("day"), grain)).groupBy("period").agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS])
    people = visitors.withColumn("period", period(F.col("day"), grain)).groupBy("period", "user_id").agg(F.max("new").alias("new"))
    counts = people.groupBy("period").agg(F.count("*").alias("visitors"), F.count_if("new").alias("new"))
    return own.join(counts, "period").withColumn("returning", F.col("visitors") - F.col("new"))


def merged_keys(keys: DataFrame, grain: str) -> DataFrame:
    return keys.withColumn("period", period(F.col("day"), grain)).groupBy("period", "dim", "key").agg(F.sum("n").cast("long").alias("n"))


def last_periods(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the n latest periods; periods are few."""
    return rows.join(F.broadcast(rows.select("period").distinct().orderBy(F.desc("period")).limit(n)), "period", "left_semi")


def ad_rows(ads: DataFrame, by: str, n: int = 20) -> DataFrame:
    """The n keys with most clicks, then impressions, with a click rate that is null without impressions."""
    rows = ads.groupBy(by).agg(F.count_if(F.col("type") == "ad_impression").alias("imp"), F.count_if(F.col("type") == "ad_click").alias("click"))
    return rows.withColumn("ctr", safe_ratio(F.col("click"), F.col("imp"))).orderBy(F.desc("click"), F.desc("imp"), by).limit(n)


def ad_totals(ads: DataFrame) -> DataFrame:
    """One row: impressions, clicks and their rate to four digits, 0 without impressions."""
    sums = ads.agg(F.count_if(F.col("type") == "ad_impression").alias("imp"), F.count_if(F.col("type") == "ad_click").alias("click"))
    return sums.withColumn("ctr", F.coalesce(half_up(safe_ratio(F.col("click"), F.col("imp")), 4), F.lit(0.0)))


def ad_spacing(stats: DataFrame, every: int = 12, baseline: float = 0.02, least: int = 5, sensitivity: float = 0.35) -> DataFrame:
    """``stats`` (imp, click) with the reader's click rate against a baseline (null below ``least`` impressions) and how many rows lie between advertisements."""
    ratio = F.when(F.col("imp") >= least, F.col("click") / F.col("imp") / baseline)
    held = F.greatest(F.lit(0.2), F.least(F.lit(3.0), ratio))
    factor = F.greatest(F.lit(0.5), F.least(F.lit(1.15), 1 / (1 + sensitivity * (held - 1))))
    rows = F.greatest(F.lit(4.0), F.least(F.lit(24.0), half_up(every * factor)))
    return stats.withColumns({"ratio": ratio, "every": F.when(ratio.isNull(), float(every)).otherwise(rows)})


def banner_order(readers: DataFrame, banners: DataFrame, weights: DataFrame, seen: DataFrame, n: int = 14, base: float = 0.35) -> DataFrame:
    """(user_id, id, relevance, place) of a short list of banners (id, category, ord): unseen first, by the reader's weight for the category, equal ones in a turn that the reader's seed begins.

    ``readers`` has user_id and seed, ``weights`` user_id, category and weight, ``seen`` user_id and id.
    """
    met = readers.crossJoin(F.broadcast(banners)).join(weights, ["user_id", "category"], "left").join(seen.select("user_id", "id", F.lit(1).alias("__seen")), ["user_id", "id"], "left")
    relevance = F.when(F.col("weight").isNull(), base).otherwise(F.greatest(F.lit(base), F.least(F.lit(1.0), F.col("weight") / 6)))
    total = F.count("*").over(Window.partitionBy("user_id"))
    rows = met.withColumns({"relevance": relevance, "__t": total})
    w = Window.partitionBy("user_id").orderBy(F.coalesce("__seen", F.lit(0)), F.desc("relevance"), (F.col("ord") + F.col("seed")) % F.col("__t"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("user_id", "id", "relevance", "place")


def participation(counts: DataFrame) -> DataFrame:
    """``counts`` (posts, comments, likes) with the score they give, its level and what the next one lacks."""
    score = F.col("posts") * 5 + F.col("comments") * 2 + F.col("likes")
    # fixed values
    floors = [0, 10, 40, 120]
    level = sum((F.when(score >= f, 1).otherwise(0) for f in floors[1:]), F.lit(0))
    missing = F.when(level == len(floors) - 1, 0)
    for at, floor in enumerate(floors[1:]):
        missing = missing.when(level == at, floor - score)
    return counts.withColumns({"score": score, "level": level, "to_next": missing})


def feed_quality(shown: DataFrame) -> DataFrame:
    """Per persona of shown rows (persona, session, page, ord, source, title, clicked, wanted, age): how a simulated run felt."""
    key = F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^0-9a-z가-힣]", ""), 1, 18)
    by = Window.partitionBy("persona").orderBy("session", "page", "ord")
    rows = shown.withColumns({"__k": key, "__run": F.coalesce(F.col("source") == F.lag("source").over(by), F.lit(False))})
    whole = rows.groupBy("persona").agg(
        F.count("*").alias("shown"),
        (F.count_if("clicked") / F.count("*")).alias("click_rate"),
        (F.count_if("wanted") / F.count("*")).alias("wanted_rate"),
        F.countDistinct("source").alias("sources"),
        F.count_if("__run").alias("same_source"),
        (F.count_if(F.col("__k") != "") - F.countDistinct(F.when(F.col("__k") != "", F.col("__k")))).alias("repeated"),
        F.count_if((F.col("session") == 0) & (F.col("page") == 0) & F.col("wanted")).alias("first_wanted"),
        (F.count_if(F.col("age").isNull()) / F.count("*")).alias("undated"),
    )
    top = rows.groupBy("persona", "source").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("persona").orderBy(F.desc("n"), "source"))
    top = top.withColumn("r", place).filter("r <= 3").groupBy("persona").agg(F.sum("n").alias("top3"))
    dull = rows.groupBy("persona", "session").agg(F.max(F.col("clicked").cast("int")).alias("c")).groupBy("persona").agg(F.count_if(F.col("c") == 0).alias("empty_sessions"))
    dated = rows.filter("age is not null")
    ages = dated.withColumns({"r": F.row_number().over(Window.partitionBy("persona").orderBy("age")) - 1, "n": F.count("*").over(Window.partitionBy("persona"))})
    middle = ages.filter("r = floor(n / 2)").select("persona", half_up(F.col("age"), 1).alias("median_age"))
    met = whole.join(top, "persona").join(dull, "persona").join(middle, "persona", "left")
    return met.withColumn("top3_share", F.col("top3") / F.col("shown")).drop("top3")


def health_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def kept_keys(events: DataFrame, key: str, ord_: str, most: int = MAX_KEYS) -> DataFrame:
    """(key, n) of the ``most`` keys that came first; later ones are dropped, as they are for advertisements."""
    keys = events.groupBy(F.col(key).alias("key")).agg(F.min(ord_).alias("first"), F.count("*").alias("n"))
    return keys.orderBy("first").limit(most).select("key", "n")


def variant_lines(variants: DataFrame, matrix: DataFrame) -> DataFrame:
    """``variants`` (variant as place_context_number, score) with the copy (dest, ctx, idx, hook) of their cell and their rate in percent."""
    parts = F.split("variant", "_")
    cells = variants.withColumns({"dest": parts[0], "ctx": parts[1], "idx": parts[2].cast("long")})
    return cells.join(matrix, ["dest", "ctx", "idx"]).withColumn("ctr", half_up(F.col("score") * 100, 2))
