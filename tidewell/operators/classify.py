"""Naive Bayes over title features, as counts and joins, and the cascade that settles a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An answer is held back below this margin a feature, or this share of known features.
MARGIN, KNOWN = 0.08, 0.2


def feature_counts(rows: DataFrame) -> DataFrame:
    """(label, feature, w) of rows (label, features, weight): weighted counts; rows of under two features teach nothing.

    Counts add up, so those of a batch can be united with those before and summed.
    """
    fit = rows.filter("label is not null and size(features) >= 2")
    return fit.select("label", "weight", F.explode("features").alias("feature")).groupBy("label", "feature").agg(F.sum("weight").alias("w"))


def merged_counts(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two).groupBy("label", "feature").agg(F.sum("w").alias("w"))


def predictions(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, label, margin, known) of rows (id, features): the likeliest label by smoothed counts and even priors.

    A label's score is the sum of ln(w + 1) over the features it knows, less
    ln(total + vocabulary) for each feature, so only features that meet counts are
    joined. ``margin`` is the lead over the second a feature, ``known`` the share
    of features in the vocabulary. Rows without features, and all rows where fewer
    than two labels are learnt, have no label. Labels are few and broadcast.
    """
    totals = counts.groupBy("label").agg(F.sum("w").alias("total"))
    facts = counts.agg(F.countDistinct("feature").alias("v"))
    labels = totals.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(totals.agg(F.count("*").alias("k")))).filter("k > 1")
    parts = rows.select("id", F.explode("features").alias("feature"))
    hits = parts.join(counts, "feature").groupBy("id", "label").agg(F.sum(F.log(F.col("w") + 1)).alias("s"))
    known = parts.join(counts.select("feature").distinct(), "feature", "left_semi").groupBy("id").agg(F.count("*").alias("in"))
    sized = rows.select("id", F.size("features").alias("n")).filter("n > 0")
    scored = sized.crossJoin(F.broadcast(labels)).join(hits, ["id", "label"], "left")
    score = F.coalesce("s", F.lit(0.0)) - F.col("n") * F.log(F.col("total") + F.col("v"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "label")
    ranked = scored.withColumn("score", F.round(score, 9)).withColumn("r", F.row_number().over(w)).filter("r <= 2")
    best = ranked.groupBy("id").agg(F.min_by("label", "r").alias("label"), (F.max_by("n", "r")).alias("n"), (F.max("score") - F.min("score")).alias("lead"))
    out = best.join(known, "id", "left").select("id", "label", (F.col("lead") / F.col("n")).alias("margin"), (F.coalesce("in", F.lit(0)) / F.col("n")).alias("known"))
    return rows.select("id").join(out, "id", "left").select("id", "label", F.coalesce("margin", F.lit(0.0)).alias("margin"), F.coalesce("known", F.lit(0.0)).alias("known"))


def answered(found: DataFrame, margin: float = MARGIN, known: float = KNOWN) -> DataFrame:
    """``found`` with its label held back where it is unsure."""
    sure = (F.col("margin") >= margin) & (F.col("known") >= known)
    return found.withColumn("label", F.when(sure, F.col("label")))


def cascade(category: Column, registered: Column, sectioned: Column, topics: Column, board: Column, keyword: Column, predicted: Column, trained: Column, overridable: list[str], kept: list[str], fallback: Column, mixed: Column) -> Column:
    """The category that an item ends with.

    Items of politics and of ``kept`` categories stay. A board or keyword decides
    where it can (on sectioned news ``keyword`` is expected to hold only what may
    override a section); sectioned news is left alone otherwise. Then comes a
    prediction of a category that may override, once 100 titles are learnt, then
    a mixed board's own fallback for items of its registered category, then the
    neutral category of mixed sources.
    """
    definite = F.coalesce(board, keyword)
    told = F.when((trained >= 100) & predicted.isin(overridable) & (predicted != category), predicted)
    return (
        F.when(F.array_contains(topics, "politics") | category.isin(kept), category)
        .when(definite.isNotNull(), definite)
        .when(sectioned, category)
        .when(told.isNotNull(), told)
        .when(fallback.isNotNull() & (category == registered), fallback)
        .when(mixed, F.lit("humor"))
        .otherwise(category)
    )


def holdout_quality(found: DataFrame) -> DataFrame:
    """(label, n, answered, right) of held-out rows (label, said), said being null where the answer is held back."""
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count("said").alias("answered"), F.count_if(F.col("said") == F.col("label")).alias("right"))
