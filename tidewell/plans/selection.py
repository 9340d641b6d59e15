"""Queries of greedy selection. Those without SQL are held against plain versions and their own rules in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import hot
from tidewell.operators import select as S
from tidewell.operators import taste as U
from tidewell.plans.base import Catalogue
from tidewell.plans.pages import _KEY
from tidewell.sources.adapters import NOW, items, preferences, registry, signals, table, tagged_items

CATALOGUE = Catalogue()
query = CATALOGUE.query


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader's rated items with what the selections need, scored as the feed does."""
    known, prefs = tagged_items(spark, sf_dir), preferences(spark, sf_dir)
    pairs = signals(spark, sf_dir).select("user_id", F.col("item_id").alias("id")).distinct()
    heat = hot.hot_scores(items(spark, sf_dir), F.expr(NOW)).select("id", "hot", "age")
    stance = U.category_sets(prefs).withColumnRenamed("key", "category")
    picks = stance.filter("stance = 'picked'").select("user_id", F.lit(True).alias("has_picks")).distinct()
    groups = registry(spark, sf_dir).select("source", "feed_group")
    rows = U.taste_scores(pairs, known, prefs).join(known, "id").join(heat, "id").join(groups, "source", "left")
    rows = rows.join(stance, ["user_id", "category"], "left").join(picks, "user_id", "left").fillna(False, ["has_picks"])
    return rows.select(
        "user_id", "id", "ord", "source", "category", "kind", "lang", "stance", "has_picks", "taste", "hot", "age", "score", "comment_count",
        F.coalesce("feed_group", "source", F.lit("unknown")).alias("key"),
        F.round(U.global_score(F.col("hot"), F.col("taste"), F.lit(0.0)), 6).alias("value"),
        F.pmod(F.xxhash64("source"), F.lit(5)).alias("exposure"),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.drop("score").withColumnRenamed("value", "score")


@query()
def select_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arranged(_ranked(candidates(spark, sf_dir)), "user_id", S.diverse_page(10), ["score desc", "ord"])


@query()
def select_diverse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page of a reader who leans to news."""
    return S.arranged(_ranked(candidates(spark, sf_dir)), "user_id", S.diverse_page(10, first_page=False, mix=0.8), ["score desc", "ord"])


@query()
def diversify_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arranged(_ranked(candidates(spark, sf_dir)), "user_id", S.diversified(), ["score desc", "ord"])


@query()
def recycled_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ten of what a reader has seen already: by hotness, made diverse, then cut from an offset."""
    rows = candidates(spark, sf_dir).drop("score").withColumn("score", F.col("hot"))
    out = S.arranged(rows, "user_id", S.diversified(), ["hot desc", "ord"])
    return out.filter("place >= 10 and place < 20")


@query()
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return S.arranged(rows, "user_id", S.round_robin(), ["hot desc", "ord"])


@query()
def latest_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("prefer", F.coalesce((F.col("stance") == "picked").cast("int"), F.lit(0)))
    return S.arranged(rows, "user_id", S.latest(), ["age", "ord"])


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's forty best items as a list, the next forty spare."""
    w = Window.partitionBy("user_id").orderBy(F.desc("hot"), "ord")
    rows = candidates(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 80")
    deal, ours = F.col("id") % 9 == 0, F.col("id") % 63 == 0
    return rows.withColumns(
        {"spare": F.col("r") > 40, "deal": deal, "ours": ours, "heat": 3 * F.col("comment_count") + 2 * F.col("score"), "chosen": F.coalesce(F.col("stance") == "picked", F.lit(False)),
         "foreign": F.col("lang") != "en", "fixed": deal}
    ).fillna(False, ["foreign"])


@query()
def cap_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arranged(_listed(spark, sf_dir).filter("not spare"), "user_id", S.deals_capped(), ["r"])


@query()
def deal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arranged(_listed(spark, sf_dir).filter("not spare or deal"), "user_id", S.deals_ensured(), ["r"])


@query()
def taste_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arranged(_listed(spark, sf_dir), "user_id", S.taste_ensured(), ["r"])


@query()
def foreign_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, sf_dir).withColumn("foreign", F.col("foreign") & (F.col("id") % 4 == 0))
    return S.arranged(rows, "user_id", S.foreign_ensured(), ["r"])


@query(
    """WITH p AS (SELECT DISTINCT user_id, item_id AS id FROM signals), m AS (SELECT p.user_id, i.id, i.ord, CASE WHEN i.id % 3 > 0 THEN 'c0' ELSE i.category END AS category FROM p JOIN items i USING (id)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY ord) > floor(count(*) OVER (PARTITION BY user_id) * 0.6) AND count(*) OVER (PARTITION BY user_id) >= 5 AS back FROM m)
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY back, ord) AS place FROM o""",
    "signals",
    "items",
)
def cap_one_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = signals(spark, sf_dir).select("user_id", F.col("item_id").alias("id")).distinct().join(items(spark, sf_dir).select("id", "ord", "category"), "id")
    rows = pairs.withColumn("category", F.expr("if(id % 3 > 0, 'c0', category)"))
    return S.one_category_capped(rows, "user_id", [F.asc("ord")], 0.6).select("user_id", "id", F.col("place").cast("long").alias("place"))


@query(
    f"""WITH RECURSIVE i AS (SELECT category, id, source, ord, score + 2 * comment_count + 50 * coverage AS value, {_KEY} AS k FROM items),
o AS (SELECT category, id, source, CASE WHEN length(k) >= 10 THEN k END AS key, row_number() OVER (PARTITION BY category ORDER BY value DESC, ord) AS n FROM i),
s(category, n, ids, sources, keys) AS (
  SELECT category, n, [id], [coalesce(source, '')], [coalesce(key, '')] FROM o WHERE n = 1
  UNION ALL SELECT category, n, CASE WHEN fits THEN list_append(ids, id) ELSE ids END, CASE WHEN fits THEN list_append(sources, source) ELSE sources END, CASE WHEN fits THEN list_append(keys, key) ELSE keys END
  FROM (SELECT o.category, o.n, ids, sources, keys, o.id, coalesce(o.source, '') AS source, coalesce(o.key, '') AS key,
      len(list_filter(sources, lambda x: x = coalesce(o.source, ''))) < 2 AND NOT (o.key IS NOT NULL AND list_contains(keys, o.key)) AS fits
    FROM s JOIN o ON o.category = s.category AND o.n = s.n + 1 WHERE len(ids) < 3)),
e AS (SELECT category, arg_max(ids, n) AS ids FROM s GROUP BY 1)
SELECT category, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM e""",
    "items",
)
def category_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items of each category, two an outlet, no event twice."""
    rows = items(spark, sf_dir).select("category", "id", "source", "ord", F.expr("score + 2 * comment_count + 50 * coverage").alias("value"), T.event_key(F.col("title")).alias("key"))
    return S.top_of_events(rows, "category", 3, 2)


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their edition, a day and one of three slots, with what a digest needs."""
    return tagged_items(spark, sf_dir).select(
        F.concat_ws("-", F.to_date("published_at"), F.expr("hour(published_at) div 8")).alias("edition"), "id", "source", "score", "comment_count", "coverage", "ord", "tags",
        T.event_key(F.col("title")).alias("key"), F.expr("score + 2 * comment_count + 50 * coverage").alias("value"),
        F.lit(0.0).alias("interest"), F.col("category").isin("c1", "c2").alias("weighty"),
    )


@query()
def cluster_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clustered(editions(spark, sf_dir), "edition", ["value desc", "ord"])


@query()
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each edition's digest."""
    rows = editions(spark, sf_dir)
    members = S.clustered(rows, "edition", ["value desc", "ord"]).join(rows, ["edition", "id"])
    return S.balanced(S.issue_weights(members, "edition"), "edition").withColumn("weight", F.round("weight", 4))


@query()
def collect_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each collecting hour, folded by url and event."""
    rows = items(spark, sf_dir).select(
        F.date_trunc("hour", "published_at").cast("string").alias("tick"), "id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("url"),
        T.event_key(F.col("title")).alias("key"), "source", "kind", "coverage", "ord",
    )
    return S.folded_batch(rows, "tick")


#: A page's short list of advertisements.
ADS = [{"relevance": 0.1 * (k % 8), "dest": f"d{k % 4}", "claims": k % 3 == 0} for k in range(12)]


@query()
def inject_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where advertisements stand among each reader's items: (user_id, place, id), -1 - k for advertisement k."""
    rows = _listed(spark, sf_dir).filter("not spare").select("user_id", "id", "r", "deal", "category")
    put = S.with_slots(ADS)

    def work(group):
        group = group.sort_values("r")
        frame = group.assign(unsafe=group["category"].eq("c6"), deal_dest=[f"d{i % 4}" if d else None for i, d in zip(group["id"], group["deal"], strict=True)], ad_dest=None).reset_index(drop=True)
        at = put(frame)
        ids = [int(frame["id"].iloc[i]) if i >= 0 else i for i in at]
        return frame.iloc[[0] * len(at)][["user_id"]].assign(place=range(len(at)), id=ids).reset_index(drop=True)

    return rows.groupBy("user_id").applyInPandas(work, "user_id long, place long, id long")


_PRODUCTS = "SELECT p_partkey AS id, p_size % 5 AS category, row_number() OVER (ORDER BY p_partkey) - 1 AS ord FROM part WHERE p_partkey <= 40"


@query(
    f"""WITH p AS ({_PRODUCTS}), u AS (SELECT c_custkey AS user_id, c_custkey % 6 AS wanted, c_custkey % 11 AS pick FROM customer),
m AS (SELECT u.user_id, p.id, pick, p.ord, CASE WHEN p.category = u.wanted THEN 0 ELSE 1 END AS tier, CASE WHEN (p.id + u.user_id) % 3 = 0 THEN 1 ELSE 0 END AS seen FROM u, p),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, tier, seen ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY user_id, tier, seen) AS n FROM m),
r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY tier, seen, (i - pick % n + n) % n) AS place FROM g)
SELECT user_id, id, place FROM r WHERE place <= 3"""
)
def product_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three products a reader from a short list: of the wanted category, then of others, unseen before seen, each group begun at the reader's turn."""
    by = Window.orderBy("p_partkey")
    products = table(spark, sf_dir, "part").filter("p_partkey <= 40").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("category"), (F.row_number().over(by) - 1).alias("ord"))
    readers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_custkey % 6 AS wanted", "c_custkey % 11 AS pick")
    met = readers.crossJoin(F.broadcast(products)).selectExpr("*", "if(category = wanted, 0, 1) AS tier", "if((id + user_id) % 3 = 0, 1, 0) AS seen")
    group = Window.partitionBy("user_id", "tier", "seen")
    met = met.withColumns({"i": F.row_number().over(group.orderBy("ord")) - 1, "n": F.count("*").over(group)})
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("tier", "seen", F.pmod(F.col("i") - F.col("pick") % F.col("n"), F.col("n"))))
    return met.select("user_id", "id", turn.cast("long").alias("place")).filter("place <= 3")
