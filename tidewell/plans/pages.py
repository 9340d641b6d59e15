"""Queries of published pages: community ranking, keywords, digests and weekly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import publish as P
from tidewell.plans.base import Catalogue
from tidewell.sources.adapters import STOP, items, table

CATALOGUE = Catalogue()
query = CATALOGUE.query

_STOP = ", ".join(f"'{w}'" for w in STOP)
_TAGS = f"list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9]{{1,15}}'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})))"


@query(
    """WITH c AS (SELECT source, category, count(*) AS n, min(ord) AS first FROM items GROUP BY ALL),
t AS (SELECT source, category FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS r FROM c) WHERE r = 1),
a AS (SELECT source, count(*) AS posts, CAST(sum(score) AS BIGINT) AS score, CAST(sum(comment_count) AS BIGINT) AS comments FROM items GROUP BY 1 HAVING count(*) >= 8)
SELECT a.source, posts, score, comments, score + comments AS reactions, CAST(floor(comments / posts + 0.5) AS DOUBLE) AS avg_comments, t.category AS top_category FROM a JOIN t ON a.source = t.source""",
    "items",
)
def community_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.community_ranking(items(spark, sf_dir), 8)


@query("SELECT id, source, score + comment_count AS reactions FROM items WHERE source = 'src3' ORDER BY reactions DESC, ord LIMIT 15", "items")
def source_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_of(items(spark, sf_dir).filter("source = 'src3'"), 15).select("id", "source", "reactions")


@query(
    f"""WITH t AS (SELECT id, source, score + comment_count AS reactions, unnest({_TAGS}) AS tag FROM items),
k AS (SELECT tag, count(*) AS items, count(DISTINCT source) AS sources, CAST(sum(reactions) AS BIGINT) AS reactions FROM t GROUP BY 1 HAVING count(DISTINCT source) >= 2 AND count(*) >= 3)
SELECT * FROM k ORDER BY reactions DESC, items DESC, tag LIMIT 60""",
    "items",
)
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = items(spark, sf_dir).withColumn("tags", T.latin_tags(F.col("title"), STOP, 1 << 20))
    return P.keyword_index(tagged, 60)


@query("SELECT id, source FROM items WHERE contains(lower(title), 'tion') ORDER BY score + comment_count DESC, ord LIMIT 20", "items")
def keyword_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best_of(items(spark, sf_dir).filter(F.lower("title").contains("tion")), 20).select("id", "source")


_KEY = r"regexp_replace(lower(regexp_replace(title, '\s+[-–—|]\s+[^-–—|]{1,30}$', '')), '[^0-9a-z가-힣]', '', 'g')"


@query(
    f"""WITH k AS (SELECT id, ord, source, {_KEY} AS key FROM items),
e AS (SELECT id, ord, CASE WHEN length(key) >= 10 THEN key END AS key FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS r FROM e)
SELECT id FROM r WHERE key IS NULL OR r = 1""",
    "items",
)
def event_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("id", "ord", T.event_key(F.col("title")).alias("key"))
    return P.first_of_key(rows, "key").select("id")


@query(
    f"""WITH k AS (SELECT source, {_KEY} AS key FROM items WHERE kind = 'news')
SELECT key, least(5, count(DISTINCT source)) AS coverage FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT source) >= 2""",
    "items",
)
def coverage_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).filter("kind = 'news'").select("source", T.event_key(F.col("title")).alias("key"))
    return P.coverage(rows, "key")


@query(
    f"""WITH k AS (SELECT id, source, ord, {_KEY} AS key FROM items),
p AS (SELECT a.id, b.id AS related, b.source, row_number() OVER (PARTITION BY a.id, b.source ORDER BY b.ord) AS s, b.ord FROM k a JOIN k b ON a.key = b.key AND a.source <> b.source WHERE length(a.key) >= 10),
r AS (SELECT id, related, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM p WHERE s = 1)
SELECT id, related FROM r WHERE r <= 5""",
    "items",
)
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("id", "source", "ord", T.event_key(F.col("title")).alias("key"))
    return P.related(rows, "key", 5)


@query(
    """WITH d AS (SELECT DISTINCT CAST(published_at AS DATE) AS day FROM items), k AS (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS back FROM d),
w AS (SELECT i.source, k.back, CAST(i.published_at AS DATE) AS day FROM items i JOIN k ON CAST(i.published_at AS DATE) = k.day WHERE back <= 7),
n AS (SELECT count(DISTINCT day) AS days FROM w)
SELECT source, count(*) AS n, count(DISTINCT day) AS days, CAST(count(*) FILTER (back <= days_all // 2) - count(*) FILTER (back > days_all - days_all // 2) AS BIGINT) AS mover
FROM w, (SELECT days AS days_all FROM n) GROUP BY 1""",
    "items",
)
def weekly_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    return P.landscape(rows, "source", 7)


_HEAT = "SELECT user_id AS id, list(CAST(floor(value) AS BIGINT) ORDER BY event_id) AS h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 14 GROUP BY 1"


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id", "bigint(floor(value)) AS v")
    return P.last_samples(rows, "id", "event_id", "v", 14)


@query(f"WITH h AS ({_HEAT}) SELECT id, array_to_string(list_transform(range(1, len(h)), lambda i: h[i + 1] - h[i]), ',') AS steps FROM h")
def step_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir).select("id", F.array_join(P.steps(F.col("h")).cast("array<string>"), ",").alias("steps"))


@query(
    f"""WITH h AS ({_HEAT}), e AS (SELECT id, unnest(h) AS v, generate_subscripts(h, 1) AS pos, list_min(h) AS lo, list_max(h) AS hi, len(h) AS n FROM h)
SELECT id, CAST(pos AS BIGINT) AS "at", CASE WHEN hi = lo THEN 0.15 ELSE floor((v - lo) / (hi - lo) * 100 + 0.5) / 100 END AS y FROM e WHERE n >= 2"""
)
def minmax_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _heat(spark, sf_dir).filter("size(h) >= 2").select("id", F.posexplode(P.scaled(F.col("h"))).alias("at", "y"))
    return scaled.select("id", (F.col("at") + 1).cast("long").alias("at"), F.col("y").cast("double").alias("y"))


@query(
    f"""WITH h AS ({_HEAT}), c AS (SELECT id, list_transform(range(1, len(h) + 1), lambda i: list_sum(h[1:i])) AS h FROM h WHERE len(h) >= 5),
s AS (SELECT id, len(h) - 1 AS k, h[len(h)] - h[1] AS total, h[CAST(ceil((len(h) - 1) / 2) AS BIGINT) + 1] - h[1] AS front FROM c)
SELECT 'g' || (id % 4) AS category, round(avg(floor(100 * front / total + 0.5)), 4) AS front_pct, count(*) AS n FROM s WHERE total >= 30 GROUP BY 1 HAVING count(*) >= 5"""
)
def heat_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    growing = _heat(spark, sf_dir).select("id", P.running_sums(F.col("h")).alias("h"), F.expr("concat('g', id % 4) AS category"))
    return P.heat_shapes(growing, "category").withColumn("front_pct", F.round("front_pct", 4))


@query(
    r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1), ''), NULL) AS t FROM pages)
SELECT page_id, nullif(trim(t), '') AS title FROM p"""
)
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.tag_text(F.col("html"), "title").alias("title"))


@query(
    r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages),
d AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(h,'&copy;','©'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&middot;','·'),'&hellip;','…'),'&ndash;','–'),'&mdash;','—'),'&amp;','&'), '<[^>]+>', ' ', 'g') AS h FROM b),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(h,'&copy;','©'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&apos;',''''),'&nbsp;',' '),'&middot;','·'),'&hellip;','…'),'&ndash;','–'),'&mdash;','—'),'&amp;','&') AS h FROM d)
SELECT page_id, trim(regexp_replace(h, '[\s ]+', ' ', 'g'), ' ') AS text FROM e"""
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


@query(
    """WITH v AS (SELECT i.id, i.source, i.category, i.score + 2 * i.comment_count AS eng, i.comment_count, i.score FROM items i),
s AS (SELECT source, avg(eng) AS mean, count(*) AS n FROM v GROUP BY 1)
SELECT id, CASE WHEN n >= 2 AND eng >= 3 * mean THEN 'outlier' WHEN comment_count >= 30 AND comment_count >= 3 * score THEN 'debate' ELSE 'plain' END AS flag FROM v JOIN s USING (source)""",
    "items",
)
def editorial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.editorial_flags(items(spark, sf_dir)).select("id", "flag")


@query(
    "SELECT source, round(avg(score), 4) AS mean, median(score) AS median, count(*) AS n FROM items GROUP BY 1", "items"
)
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("source").agg(F.round(F.avg("score"), 4).alias("mean"), F.median("score").alias("median"), F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT id, category, source, ord, score + 2 * comment_count + 50 * coverage AS w FROM items)
SELECT id, source, w FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, ord) AS r FROM w) WHERE r <= 6 ORDER BY w DESC, ord LIMIT 60""",
    "items",
)
def briefing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.hot import capped_top

    rows = items(spark, sf_dir).withColumn("w", F.expr("score + 2 * comment_count + 50 * coverage"))
    return capped_top(rows, 6, 60, order=(F.desc("w"), F.asc("ord"))).select("id", "source", "w")


@query("SELECT max(struct_pack(c := comment_count, o := -ord)).o * -1 AS id FROM items WHERE comment_count >= 30", "items")
def debate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = items(spark, sf_dir).filter("comment_count >= 30").agg(F.max(F.struct("comment_count", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select((-F.col("b.o")).alias("id"))
