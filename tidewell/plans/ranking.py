"""Queries of hotness and ranking, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.maths import probit
from tidewell.operators import hot
from tidewell.operators import publish as P
from tidewell.plans.base import Catalogue
from tidewell.sources.adapters import NOW, items, registry, table

CATALOGUE = Catalogue()
query = CATALOGUE.query

def now():
    return F.expr(NOW)


# fixed values: the approximation's coefficients
_PROBIT = """
CASE WHEN q < 0.02425 THEN
  (((((-7.784894002430293e-03*sqrt(-2*ln(q))-3.223964580411365e-01)*sqrt(-2*ln(q))-2.400758277161838e+00)*sqrt(-2*ln(q))-2.549732539343734e+00)*sqrt(-2*ln(q))+4.374664141464968e+00)*sqrt(-2*ln(q))+2.938163982698783e+00)
  /((((7.784695709041462e-03*sqrt(-2*ln(q))+3.224671290700398e-01)*sqrt(-2*ln(q))+2.445134137142996e+00)*sqrt(-2*ln(q))+3.754408661907416e+00)*sqrt(-2*ln(q))+1)
WHEN q > 1-0.02425 THEN
 -(((((-7.784894002430293e-03*sqrt(-2*ln(1-q))-3.223964580411365e-01)*sqrt(-2*ln(1-q))-2.400758277161838e+00)*sqrt(-2*ln(1-q))-2.549732539343734e+00)*sqrt(-2*ln(1-q))+4.374664141464968e+00)*sqrt(-2*ln(1-q))+2.938163982698783e+00)
  /((((7.784695709041462e-03*sqrt(-2*ln(1-q))+3.224671290700398e-01)*sqrt(-2*ln(1-q))+2.445134137142996e+00)*sqrt(-2*ln(1-q))+3.754408661907416e+00)*sqrt(-2*ln(1-q))+1)
ELSE
  (((((-3.969683028665376e+01*r+2.209460984245205e+02)*r-2.759285104469687e+02)*r+1.383577518672690e+02)*r-3.066479806614716e+01)*r+2.506628277459239e+00)*(q-0.5)
  /(((((-5.447609879822406e+01*r+1.615858368580409e+02)*r-1.556989798598866e+02)*r+6.680131188771972e+01)*r-1.328068155288572e+01)*r+1)
END"""

_HOT = f"""
WITH r AS (SELECT *, CAST(greatest(0, score + 2 * comment_count) AS DOUBLE) AS raw FROM items),
m AS (SELECT *, median(raw) OVER (PARTITION BY source) AS med, max(raw) OVER (PARTITION BY source) AS top,
             count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS place FROM r),
d AS (SELECT *, median(abs(raw - med)) OVER (PARTITION BY source) AS mad,
             greatest(1e-6, least(1 - 1e-6, 1 - place / greatest(n - 1, 1))) AS q FROM m),
z AS (SELECT *, (q - 0.5) * (q - 0.5) AS r FROM d),
s AS (SELECT *, CASE WHEN top > 0 THEN CASE WHEN mad > 0 THEN (raw - med) / (1.4826 * mad) ELSE 0 END
                     ELSE {_PROBIT} + 0.8 * least(1.0, coverage / 5) END AS norm,
             CASE WHEN top > 0 THEN raw / (raw + 10) ELSE 0.6 END AS confidence,
             epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0 AS age FROM z),
h AS (SELECT *, 1 / (1 + exp(-norm * confidence)) / pow(age + 2, 1.8) AS decayed FROM s),
hot AS (SELECT *, floor((decayed + 0.3 * log10(1 + CASE WHEN top > 0 THEN raw / (age + 2) ELSE 0 END)) * 1e6 + 0.5) / 1e6 AS hot FROM h)
"""


@query(
    """
WITH r AS (SELECT id, source, CAST(greatest(0, score + 2 * comment_count) AS DOUBLE) AS raw FROM items),
m AS (SELECT *, median(raw) OVER (PARTITION BY source) AS med FROM r),
d AS (SELECT *, median(abs(raw - med)) OVER (PARTITION BY source) AS mad FROM m)
SELECT id, source, raw, round(CASE WHEN mad > 0 THEN (raw - med) / (1.4826 * mad) ELSE 0 END, 4) AS z FROM d""",
    "items",
)
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("raw", hot.raw_engagement().cast("double")).select("id", "source", "raw")
    return hot.robust_z(rows, "raw", ["source"]).withColumn("z", F.round("z", 4)).select("id", "source", "raw", "z")


@query(
    f"""
WITH p AS (SELECT p_partkey, greatest(1e-6, least(1 - 1e-6, p_size / 51.0)) AS q FROM part),
z AS (SELECT *, (q - 0.5) * (q - 0.5) AS r FROM p)
SELECT p_partkey, round({_PROBIT}, 6) AS z FROM z"""
)
def probit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(probit(F.col("p_size") / 51.0), 6).alias("z"))


@query(_HOT + "SELECT id, source, round(norm, 4) AS norm, round(confidence, 4) AS confidence, round(hot, 6) AS hot FROM hot", "items")
def hot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hot.hot_scores(items(spark, sf_dir), now())
    return scored.select("id", "source", F.round("norm", 4).alias("norm"), F.round("confidence", 4).alias("confidence"), F.round("hot", 6).alias("hot"))


@query(_HOT + "SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY hot DESC, ord) - 1 AS rank FROM hot", "items")
def hot_rank_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.rank_in_group(hot.hot_scores(items(spark, sf_dir), now()), "source").select("id", "source", F.col("rank").cast("long").alias("rank"))


@query(
    _HOT + "SELECT * FROM (SELECT id, source, round(hot, 6) AS hot, row_number() OVER (PARTITION BY source ORDER BY hot DESC, ord) AS rank FROM hot) WHERE rank <= 6",
    "items",
)
def hot_top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = hot.top_per_group(hot.hot_scores(items(spark, sf_dir), now()), "source", 6)
    return best.select("id", "source", F.round("hot", 6).alias("hot"), F.col("rank").cast("long").alias("rank"))


@query(
    """
WITH r AS (SELECT *, CAST(score + 2 * comment_count AS DOUBLE) AS raw, epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0 AS age FROM items),
f AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, max(raw) OVER (PARTITION BY source) AS top,
             row_number() OVER (PARTITION BY source ORDER BY raw DESC, ord) - 1 AS rank, exp(-age / 48) AS fresh FROM r),
p AS (SELECT *, CASE WHEN top > 0 THEN floor((n - rank) / n * 1000 + 0.5) / 1000 END AS percentile FROM f)
SELECT id, source, percentile,
       CASE WHEN top > 0 THEN floor((0.7 * percentile + 0.6 * fresh) * 1000 + 0.5) / 1000 ELSE round(fresh * 0.5, 6) END AS hot_score
FROM p WHERE top <= 0 OR rank < greatest(1, ceil(n * 0.6))""",
    "items",
)
def hot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.hot_gate(items(spark, sf_dir), now()).select("id", "source", "percentile", F.round("hot_score", 6).alias("hot_score"))


@query(
    """
SELECT id, round((0.35 + log10(1 + 3 * comment_count + 2 * score)) * pow(0.5, epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0 / 12), 5) AS deal_rank
FROM items""",
    "items",
)
def deal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot.deal_rank(items(spark, sf_dir), now()).select("id", F.round("deal_rank", 5).alias("deal_rank"))


@query(
    _HOT
    + """, e AS (SELECT * FROM hot WHERE raw >= 30 OR coverage >= 3),
v AS (SELECT id, source, ord, hot + least(coverage, 5) * 0.05 AS value FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, ord) AS r FROM v)
SELECT id, source, round(value, 4) AS value FROM c WHERE r <= 2 ORDER BY c.value DESC, ord LIMIT 30""",
    "items",
)
def ranking_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hot.hot_scores(items(spark, sf_dir), now()).filter("raw >= 30 or coverage >= 3")
    rows = rows.withColumn("value", F.col("hot") + F.least("coverage", F.lit(5)) * 0.05)
    best = hot.capped_top(rows, 2, 30, order=(F.desc("value"), F.asc("ord")))
    return best.select("id", "source", F.round("value", 4).alias("value"))


@query(
    _HOT
    + """, e AS (SELECT * FROM hot WHERE raw >= 30 OR coverage >= 3),
v AS (SELECT id, source, ord, hot + least(coverage, 5) * 0.05 AS value FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, ord) AS r FROM v),
t AS (SELECT id FROM c WHERE r <= 2 ORDER BY c.value DESC, ord LIMIT 30),
told AS (SELECT id, CASE id % 5 WHEN 0 THEN '자세한 내용은 ' || coalesce(summary, '') WHEN 1 THEN 'the same words on every page of a site' WHEN 2 THEN 'short' ELSE coalesce(summary, '') END AS s FROM items JOIN t USING (id)),
blank AS (SELECT id, substring(s, 1, 200) AS summary, trim(substring(s, 1, 200), ' ') AS k FROM told)
SELECT id, CASE WHEN length(k) < 20 OR count(*) OVER (PARTITION BY k) > 1 OR k LIKE '자세한 내용은%' THEN '' ELSE summary END AS summary FROM blank""",
    "items",
)
def ranking_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the ranking page, blank where they are filler, too short or their site's own on every page."""
    told = "CASE id % 5 WHEN 0 THEN concat('자세한 내용은 ', coalesce(summary, '')) WHEN 1 THEN 'the same words on every page of a site' WHEN 2 THEN 'short' ELSE summary END"
    rows = ranking_top(spark, sf_dir).select("id").join(items(spark, sf_dir).selectExpr("id", f"{told} AS summary"), "id")
    return P.own_summaries(rows).select("id", "summary")


@query(
    """
WITH e AS (SELECT CAST(published_at AS DATE) AS day, id % 97 AS story, source, score + 2 * comment_count AS hot, ord FROM items),
b AS (SELECT story, max(struct_pack(hot := hot, ord := -ord, source := source)) AS s FROM e WHERE day > DATE '2024-01-31' - 8 GROUP BY story),
c AS (SELECT story, s.source AS source, s.hot AS hot, row_number() OVER (PARTITION BY s.source ORDER BY s.hot DESC, story) AS r FROM b)
SELECT story, source, hot FROM c WHERE r <= 2 ORDER BY c.hot DESC, story LIMIT 20""",
    "items",
)
def period_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best showing of each story over the last week of editions, two a source."""
    rows = items(spark, sf_dir).selectExpr("to_date(published_at) AS day", "id % 97 AS story", "source", "score + 2 * comment_count AS hot", "ord")
    best = rows.filter("day > date '2024-01-31' - 8").groupBy("story").agg(F.max(F.struct("hot", (-F.col("ord")).alias("o"), "source")).alias("s"))
    best = best.select("story", "s.source", "s.hot")
    return hot.capped_top(best, 2, 20, order=(F.desc("hot"), F.asc("story")))


@query(
    """
SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, ord) AS r, kind FROM items)
WHERE r <= CASE WHEN kind = 'news' THEN 20 ELSE 100 END""",
    "items",
)
def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("source").orderBy(F.desc("published_at"), "ord")
    rows = items(spark, sf_dir).select("id", "source", "kind", "published_at", "ord").withColumn("r", F.row_number().over(by))
    return rows.filter("r <= 100").filter("r <= if(kind = 'news', 20, 100)").select("id", "source")


@query(
    """WITH i AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'me' ELSE source END AS source, kind, published_at, ord FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, ord) AS r FROM i)
SELECT id, source FROM r WHERE source = 'me' OR kind <> 'news' OR r <= 7""",
    "items",
)
def per_source_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps by settings: seven for news, by the caller over the settings, none for communities, and a reader's own posts exempt."""
    rows = items(spark, sf_dir).select("id", F.when(F.col("id") % 50 == 0, "me").otherwise(F.col("source")).alias("source"), "kind", "published_at", "ord")
    cap = hot.resolved_cap(F.col("kind"), by_kind={"news": 7}, set_by_kind={"news": 3, "community": 0}, shared=5)
    return hot.per_source(rows, cap).select("id", "source")


_CANON = r"""p AS (SELECT page_id AS id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS base,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path, string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') AS parts FROM pages),
k AS (SELECT id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
j AS (SELECT id, string_agg(part || CASE WHEN contains(part, '=') THEN '' ELSE '=' END, '&' ORDER BY split_part(part, '=', 1), i) AS query
  FROM k WHERE part <> '' AND NOT regexp_matches(split_part(part, '=', 1), '(?i)^(utm_|fbclid|gclid|igshid|ref$)') GROUP BY id),
canon AS (SELECT p.id, CASE WHEN base <> '' THEN base || CASE WHEN path = '' THEN '/' ELSE path END || coalesce('?' || query, '') END AS canonical FROM p LEFT JOIN j USING (id))"""


@query(f"WITH {_CANON} SELECT id, canonical FROM canon")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.functions.text import canonical_url

    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), canonical_url(F.col("url")).alias("canonical"))


@query(
    f"""WITH {_CANON}, r AS (SELECT id, canonical, row_number() OVER (PARTITION BY canonical ORDER BY id * 37 % 101 DESC, id) AS r FROM canon)
SELECT id AS page_id, canonical AS url FROM r WHERE canonical IS NULL OR r = 1"""
)
def url_canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per canonical url of all pages, that of the greatest value; pages without url all stay."""
    from tidewell.functions.text import canonical_url

    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("ord"), "url", F.expr("page_id * 37 % 101 AS value"))
    winners = hot.url_winners(rows, canonical_url(F.col("url")), F.col("value"))
    return winners.select("page_id", F.col("__url").alias("url"))


@query(
    """
SELECT i.id, i.source FROM items i LEFT JOIN registry r ON i.source = r.source
WHERE NOT r.adult AND r.enabled AND i.category <> 'c6'
  AND NOT (epoch(TIMESTAMP '2024-01-31 00:00:00' - i.published_at) / 3600.0 >
           CASE WHEN r.max_age_h IS NOT NULL AND (r.max_age_h <= CASE WHEN i.kind = 'news' THEN 24 ELSE 48 END OR i.score + i.comment_count + i.coverage > 0) THEN r.max_age_h
                WHEN i.kind = 'news' THEN 24 ELSE 48 END)""",
    "items",
    "registry",
)
def fresh_gate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.gates import fresh_only

    rows = items(spark, sf_dir).filter("category != 'c6'")
    known = registry(spark, sf_dir)
    return fresh_only(rows, known, now()).filter("enabled and not adult").select("id", "source")


_GROUPED = _HOT.replace("WITH r AS (SELECT *, CAST(", "WITH g AS (SELECT i.*, coalesce(feed_group, i.source, 'unknown') AS grp, id % 9 AS source_rank, CASE WHEN id % 4 = 0 THEN 0.4 END AS prior FROM items i LEFT JOIN registry USING (source)), r AS (SELECT *, CAST(").replace("FROM items),\nm", "FROM g),\nm").replace("PARTITION BY source", "PARTITION BY grp").replace("row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS place", "source_rank AS place")


@query(
    _GROUPED + "SELECT id, grp, round(CASE WHEN prior IS NOT NULL AND f < prior THEN floor((0.7 * prior + 0.3 * f) * 1e6 + 0.5) / 1e6 ELSE hot END, 6) AS hot FROM (SELECT *, decayed + 0.3 * log10(1 + CASE WHEN top > 0 THEN raw / (age + 2) ELSE 0 END) AS f FROM hot)",
    "items",
    "registry",
)
def hot_scores_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotness by feed group, by the rank a source gave its items, and with the score of the tick before, which a falling one keeps most of."""
    known = registry(spark, sf_dir).select("source", "feed_group")
    rows = items(spark, sf_dir).join(known, "source", "left").withColumn("grp", F.coalesce("feed_group", "source", F.lit("unknown")))
    rows = rows.withColumns({"source_rank": F.col("id") % 9, "before": F.expr("if(id % 4 = 0, 0.4D, null)")})
    return hot.hot_scores(rows, now(), "grp", prior="before").select("id", "grp", F.round("hot", 6).alias("hot"))


@query(
    """SELECT id, floor((0.7 * log10(1 + score + 2 * comment_count) + 0.6 * CASE WHEN id % 6 > 0 THEN exp(-(epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0) / 48) ELSE 0.5 END) * 1000 + 0.5) / 1000 AS hotness FROM items""",
    "items",
)
def hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("published_at", F.expr("if(id % 6 > 0, published_at, null)"))
    return rows.select("id", hot.hotness(now()).alias("hotness"))
