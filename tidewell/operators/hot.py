"""Hotness: robust per-group normalisation, shrinkage, decay, gates and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.maths import bayes_weight, gravity, half_life, half_up, probit

HOUR = 3.6e9
#: Share of the old score that a falling score keeps.
INERTIA = 0.7
COVERAGE_MAX = 5
RANK_ONLY_CONFIDENCE = 0.6


def raw_engagement() -> Column:
    return F.greatest(F.lit(0), F.coalesce("score", F.lit(0)) + 2 * F.coalesce("comment_count", F.lit(0)))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / HOUR


def hot_age(now: Column, seen: Column | None = None, neutral: float = 12.0) -> Column:
    """Hours since first seen, else since publication, else neutral; never negative."""
    age = hours_between(now, F.coalesce(seen, F.col("published_at")) if seen is not None else F.col("published_at"))
    return F.when(age.isNull(), neutral).otherwise(F.greatest(F.lit(0.0), age))


def freshness(age: Column) -> Column:
    """exp(-age / 48 hours), a half for unknown ages; greatest alone would take those for 0."""
    return F.when(age.isNull(), 0.5).otherwise(F.exp(-F.greatest(age, F.lit(0.0)) / 48))


def robust_z(rows: DataFrame, value: str, group: list[str], out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD) in each group; 0 where the MAD is 0.

    Medians come from two aggregations with map-side partials, joined back; groups
    aren't gathered for a window.
    """
    middle = rows.groupBy(*group).agg(F.median(value).alias("__m"))
    off = rows.join(middle, group).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    spread = off.groupBy(*group).agg(F.median("__d").alias("__s"))
    scaled = off.join(spread, group)
    z = F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / (1.4826 * F.col("__s"))).otherwise(F.lit(0.0))
    return scaled.withColumn(out, z).drop("__m", "__d", "__s")


def hot_scores(items: DataFrame, now: Column, group: str = "source", velocity: float = 0.3, prior: str | None = None) -> DataFrame:
    """``items`` with raw, has_signal, confidence, age, decayed and hot.

    Groups with any engagement use the robust z of it, shrunk by raw / (raw + 10);
    others the probit of their order (``source_rank`` if there, else arrival) with
    a bonus for coverage and a fixed confidence. The logistic of that decays with
    age; velocity adds to groups with signal. A falling score keeps most of ``prior``.
    """
    rows = items.withColumn("raw", raw_engagement().cast("double"))
    facts = rows.groupBy(group).agg(F.max("raw").alias("__top"), F.count("*").alias("__n"))
    rows = robust_z(rows, "raw", [group]).join(facts, group)
    place = F.row_number().over(Window.partitionBy(group).orderBy("ord")) - 1
    order = F.coalesce(F.col("source_rank"), place) if "source_rank" in items.columns else place
    signal = F.col("__top") > 0
    quiet = probit(1 - order / F.greatest(F.col("__n") - 1, F.lit(1))) + 0.8 * F.least(F.lit(1.0), F.col("coverage") / COVERAGE_MAX)
    rows = rows.withColumns({"has_signal": signal, "norm": F.when(signal, F.col("z")).otherwise(quiet), "age": hot_age(now)})
    confidence = F.when(F.col("has_signal"), bayes_weight(F.col("raw"), 10)).otherwise(RANK_ONLY_CONFIDENCE)
    rows = rows.withColumn("confidence", confidence)
    rows = rows.withColumn("decayed", gravity(1 / (1 + F.exp(-F.col("norm") * F.col("confidence"))), F.col("age")))
    speed = F.when(F.col("has_signal"), F.col("raw") / (F.col("age") + 2)).otherwise(F.lit(0.0))
    fresh = F.col("decayed") + velocity * F.log10(1 + speed)
    if prior:
        fresh = F.when(F.col(prior).isNull() | (fresh >= F.col(prior)), fresh).otherwise(INERTIA * F.col(prior) + (1 - INERTIA) * fresh)
    return rows.withColumn("hot", half_up(fresh, 6)).drop("__top", "__n", "z")


def rank_in_group(rows: DataFrame, group: str, score: str = "hot") -> DataFrame:
    """``rows`` with rank from 0 by score, equal ones by arrival."""
    by = Window.partitionBy(group).orderBy(F.desc(score), "ord")
    return rows.withColumn("rank", F.row_number().over(by) - 1)


def top_per_group(rows: DataFrame, group: str, k: int, score: str = "hot") -> DataFrame:
    """The k best of each group; Spark drops the others before the shuffle."""
    by = Window.partitionBy(group).orderBy(F.desc(score), "ord")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def capped_top(rows: DataFrame, per_group: int, n: int, group: str = "source", order: tuple[Column, ...] = ()) -> DataFrame:
    """The n best with at most ``per_group`` of a group: a window cap, then a top-n without a global sort."""
    order = order or (F.desc("hot"), F.asc("ord"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= per_group).drop("__r").orderBy(*order).limit(n)


def hot_gate(items: DataFrame, now: Column, share: float = 0.6) -> DataFrame:
    """The hot share of each source.

    With signal in a source its best max(1, ceil(share n)) stay, scored by
    percentile and freshness; without, all stay at half their freshness.
    """
    rows = items.withColumn("raw", raw_engagement().cast("double"))
    fresh = freshness(hours_between(now, F.col("published_at")))
    facts = rows.groupBy("source").agg(F.count("*").alias("n"), F.max("raw").alias("top"))
    by = Window.partitionBy("source").orderBy(F.desc("raw"), "ord")
    rows = rows.join(facts, "source").withColumn("rank", F.row_number().over(by) - 1).withColumn("fresh", fresh)
    percentile = F.when(F.col("top") > 0, half_up((F.col("n") - F.col("rank")) / F.col("n"), 3))
    score = F.when(F.col("top") > 0, half_up(0.7 * percentile + 0.6 * F.col("fresh"), 3)).otherwise(F.col("fresh") * 0.5)
    keep = (F.col("top") <= 0) | (F.col("rank") < F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    return rows.withColumns({"percentile": percentile, "hot_score": score}).filter(keep)


def deal_rank(items: DataFrame, now: Column) -> DataFrame:
    """``items`` with rank value: log of reactions over a floor, halved every 12 hours."""
    views = F.col("view_count") if "view_count" in items.columns else F.lit(0)
    heat = 3 * F.col("comment_count") + 2 * F.col("score") + F.log10(1 + F.greatest(F.lit(0), F.coalesce(views, F.lit(0))))
    age = F.greatest(F.lit(0.0), F.coalesce(hours_between(now, F.col("published_at")), F.lit(0.0)))
    return items.withColumn("deal_rank", (0.35 + F.log10(1 + F.greatest(F.lit(0.0), heat))) * half_life(age, 12))


def url_winners(rows: DataFrame, url: Column, value: Column) -> DataFrame:
    """One row per url, that of the greatest value, the first of equal ones; rows without url all stay."""
    keyed = rows.withColumn("__url", url)
    by = Window.partitionBy("__url").orderBy(value.desc(), "ord")
    best = keyed.filter("__url is not null").withColumn("__r", F.row_number().over(by)).filter("__r = 1").drop("__r")
    return best.unionByName(keyed.filter("__url is null"))


def hotness(now: Column) -> Column:
    """The older score: reactions by logarithm and freshness of two days, a half of it for unknown ages."""
    return half_up(0.7 * F.log10(1 + raw_engagement()) + 0.6 * freshness(hours_between(now, F.col("published_at"))), 3)


#: Items that a source may hold at once, by its kind.
CAPS = {"news": 20, "community": 100}


def resolved_cap(kind: Column, everywhere: int | None = None, by_kind: dict[str, int] | None = None, set_by_kind: dict[str, int] | None = None, shared: int | None = None) -> Column:
    """A source's cap: one set for everywhere, else the caller's for its kind, else that of the settings, else the settings' shared one, else CAPS. Kinds but news count as community."""
    if everywhere is not None:
        return F.lit(everywhere)

    def of(name: str) -> int:
        for told in (by_kind or {}, set_by_kind or {}):
            if told.get(name) is not None:
                return int(told[name])
        return CAPS[name] if shared is None else int(shared)

    return F.when(kind == "news", of("news")).otherwise(of("community"))


def per_source(rows: DataFrame, cap: Column, exempt: tuple[str, ...] = ("seed", "me"), order: tuple[Column, ...] = ()) -> DataFrame:
    """``rows`` (source, published_at, ord) of each source within its ``cap``, the newest; a cap of 0 is none, and ``exempt`` sources keep all."""
    order = order or (F.desc("published_at"), F.asc("ord"))
    free = F.coalesce(F.col("source").isin(*exempt), F.lit(False)) | (cap <= 0)
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    return rows.withColumns({"__cap": cap, "__free": free}).withColumn("__place", F.when(~F.col("__free"), place)).filter("__free or __place <= __cap").drop("__cap", "__free", "__place")
