"""Queries of reports for readers, editors and administrators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.operators import audience as A
from tidewell.operators import hot
from tidewell.operators import publish as P
from tidewell.plans.audience import _ADS, _METRICS, _ads, source_health
from tidewell.plans.audience import CATALOGUE as AUDIENCE
from tidewell.plans.base import Catalogue
from tidewell.sources.adapters import NOW, items, met_items, signals, table, track_events

CATALOGUE = Catalogue()
query = CATALOGUE.query
SOURCE_HEALTH = AUDIENCE.oracles["source_health"]


def _buckets(spark: SparkSession, sf_dir: str):
    events = track_events(spark, sf_dir).withColumn("depth", F.col("k"))
    return A.day_buckets(events, {"type": F.col("type"), "decade": A.rank_decade(F.col("k"))})


def _period(grain: str) -> str:
    return {"week": "CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR)", "month": "strftime(day, '%Y-%m')"}[grain]


def _merged(grain: str):
    sql = f"""WITH f AS (SELECT user_id, min(day) AS first FROM track GROUP BY 1), p AS (SELECT *, {_period(grain)} AS period FROM track),
n AS (SELECT p.period, count(DISTINCT p.user_id) AS visitors, count(DISTINCT p.user_id) FILTER (p.day = f.first) AS new FROM p JOIN f USING (user_id) GROUP BY 1),
m AS (SELECT period, {_METRICS} FROM p GROUP BY 1)
SELECT m.period, pv, sessions, dwell_ms, dwell_n, depth, depth_n, clicks, ad_imp, ad_click, n.visitors, n.new, n.visitors - n.new AS returning FROM m JOIN n USING (period)"""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        totals, _, visitors = _buckets(spark, sf_dir)
        return A.merged_totals(totals, visitors, grain).withColumn("period", F.col("period").cast("string"))

    f.__name__ = f"bucket_{grain}"
    query(sql, "track")(f)


_merged("week")
_merged("month")


@query(
    """WITH p AS (SELECT strftime(day, '%Y-%m') AS period, 'type' AS dim, type AS key FROM track UNION ALL SELECT strftime(day, '%Y-%m'), 'decade', CAST(k // 10 * 10 + 1 AS VARCHAR) || '~' || CAST(k // 10 * 10 + 10 AS VARCHAR) FROM track WHERE k >= 0)
SELECT period, dim, key, count(*) AS n FROM p GROUP BY ALL""",
    "track",
)
def bucket_keys_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merged_keys(_buckets(spark, sf_dir)[1], "month")


@query(
    "SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (type = 'view') AS pv, count(*) FILTER (type = 'click') AS feed, count(DISTINCT user_id) AS visitors FROM track WHERE day > (SELECT max(day) - 14 FROM track) GROUP BY 1", "track"
)
def traffic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fourteen days; clicks stand for calls of the feed."""
    rows = track_events(spark, sf_dir).withColumn("period", F.col("day"))
    days = rows.groupBy("period").agg(F.count_if(F.col("type") == "view").alias("pv"), F.count_if(F.col("type") == "click").alias("feed"), F.countDistinct("user_id").alias("visitors"))
    return A.last_periods(days, 14).withColumnRenamed("period", "day").withColumn("day", F.col("day").cast("string"))


@query(
    f"""WITH a AS ({_ADS}), c AS (SELECT variant AS key, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM a GROUP BY 1)
SELECT key, imp, click, round(CASE WHEN imp > 0 THEN click / imp END, 6) AS ctr FROM c ORDER BY click DESC, imp DESC, key LIMIT 20""",
    "track",
)
def ad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ad_rows(_ads(spark, sf_dir).withColumnRenamed("variant", "key"), "key").withColumn("ctr", F.round("ctr", 6))


@query(
    f"""WITH a AS ({_ADS}), t AS (SELECT count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM a),
r AS (SELECT event_id FROM a ORDER BY event_id DESC LIMIT 50)
SELECT 'total' AS what, imp, click, floor(click / imp * 10000 + 0.5) / 10000 AS ctr FROM t UNION ALL SELECT 'recent', event_id, NULL, NULL FROM r""",
    "track",
)
def ad_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, and the fifty latest events by their ids."""
    ads = _ads(spark, sf_dir)
    total = A.ad_totals(ads).select(F.lit("total").alias("what"), "imp", "click", "ctr")
    recent = ads.orderBy(F.desc("event_id")).limit(50).select(F.lit("recent").alias("what"), F.col("event_id").alias("imp"), F.lit(None).cast("long").alias("click"), F.lit(None).cast("double").alias("ctr"))
    return total.union(recent)


@query(
    f"""WITH a AS ({_ADS}), c AS (SELECT user_id, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM a GROUP BY 1),
r AS (SELECT *, CASE WHEN imp >= 5 THEN click / imp / CAST(0.2 AS DOUBLE) END AS ratio FROM c)
SELECT user_id, imp, click, round(ratio, 6) AS ratio, CAST(CASE WHEN ratio IS NULL THEN 12 ELSE greatest(4, least(24, floor(12 * greatest(0.5, least(1.15, 1 / (1 + CAST(0.35 AS DOUBLE) * (greatest(0.2, least(3, ratio)) - 1)))) + 0.5))) END AS DOUBLE) AS every FROM r""",
    "track",
)
def ad_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _ads(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("type") == "ad_impression").alias("imp"), F.count_if(F.col("type") == "ad_click").alias("click"))
    return A.ad_spacing(stats, baseline=0.2).withColumn("ratio", F.round("ratio", 6))


@query(
    """WITH b AS (SELECT p_partkey AS id, p_size % 5 AS category, p_partkey AS ord FROM part WHERE p_partkey < 30), u AS (SELECT c_custkey AS user_id, c_custkey % 17 AS seed FROM customer),
m AS (SELECT user_id, id, CASE WHEN category = user_id % 5 THEN greatest(0.35, least(1.0, (user_id % 8) / CAST(6 AS DOUBLE))) ELSE 0.35 END AS relevance, CASE WHEN (user_id + id) % 4 = 0 THEN 1 ELSE 0 END AS seen, (ord + seed) % 30 AS turn FROM u, b)
SELECT user_id, id, round(relevance, 6) AS relevance, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen, relevance DESC, turn) AS place FROM m) WHERE place <= 14"""
)
def banner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    banners = table(spark, sf_dir, "part").filter("p_partkey < 30").selectExpr("p_partkey AS id", "p_size % 5 AS category", "p_partkey AS ord")
    readers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_custkey % 17 AS seed")
    weights = readers.selectExpr("user_id", "user_id % 5 AS category", "double(user_id % 8) AS weight")
    seen = readers.crossJoin(F.broadcast(banners.select("id"))).filter("(user_id + id) % 4 = 0").select("user_id", "id")
    return A.banner_order(readers, banners, weights, seen).select("user_id", "id", F.round("relevance", 6).alias("relevance"), F.col("place").cast("long").alias("place"))


@query(
    """WITH h AS (SELECT user_id, ts FROM events WHERE event_type IN ('view', 'purchase')), l AS (SELECT max(ts) AS now FROM events)
SELECT user_id, count(*) FILTER (now - ts < INTERVAL 24 HOUR) AS served FROM h, l GROUP BY 1"""
)
def ads_served_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertisements each reader met in the last 24 hours, one exactly that old left out."""
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    rows = events.filter("event_type in ('view', 'purchase')").crossJoin(now)
    return rows.groupBy("user_id").agg(F.count_if(F.expr("now - ts < interval 24 hours")).alias("served"))


@query(f"SELECT status, count(*) AS n FROM (SELECT source, status FROM ({SOURCE_HEALTH})) GROUP BY 1")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the status of their health."""
    return A.health_summary(source_health(spark, sf_dir))


@query(
    """WITH c AS (SELECT o_custkey AS user_id, count(*) AS posts, count(*) FILTER (o_orderstatus = 'F') AS comments, count(*) FILTER (o_orderpriority = '1-URGENT') AS likes FROM orders GROUP BY 1), s AS (SELECT *, posts * 5 + comments * 2 + likes AS score FROM c)
SELECT user_id, posts, comments, likes, score, CASE WHEN score >= 120 THEN 3 WHEN score >= 40 THEN 2 WHEN score >= 10 THEN 1 ELSE 0 END AS level, CASE WHEN score >= 120 THEN 0 WHEN score >= 40 THEN 120 - score WHEN score >= 10 THEN 40 - score ELSE 10 - score END AS to_next FROM s"""
)
def participation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("posts"), F.count_if(F.col("o_orderstatus") == "F").alias("comments"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("likes"))
    return A.participation(counts)


@query("SELECT (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM documents) AS posts, (SELECT count(*) FROM conversations) AS comments, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_id % 200 FROM events)) AS ratings, (SELECT count(*) FROM events) AS signals")
def admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    one = events.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("signals"))
    rated = events.selectExpr("user_id", "event_id % 200 AS item").distinct().agg(F.count("*").alias("ratings"))
    return one.crossJoin(rated).crossJoin(table(spark, sf_dir, "documents").agg(F.count("*").alias("posts"))).crossJoin(table(spark, sf_dir, "conversations").agg(F.count("*").alias("comments")))


_SHOWN = """shown AS (SELECT 'p' || (e.user_id % 6) AS persona, e.user_id // 6 AS session, e.event_id % 3 AS page, e.event_id AS ord, i.source, i.title, e.event_type = 'click' AS clicked, i.category IN ('c1', 'c2') AS wanted,
  CASE WHEN i.id % 9 > 0 THEN epoch(TIMESTAMP '2024-01-31 00:00:00' - i.published_at) / 3600.0 END AS age FROM events e JOIN items i ON i.id = e.event_id % (SELECT count(*) FROM documents))"""


@query(
    f"""WITH {_SHOWN}, k AS (SELECT *, left(regexp_replace(lower(coalesce(title, '')), '[^0-9a-z가-힣]', '', 'g'), 18) AS key, lag(source) OVER (PARTITION BY persona ORDER BY session, page, ord) AS prev FROM shown),
w AS (SELECT persona, count(*) AS shown, count(*) FILTER (clicked) / count(*) AS click_rate, count(*) FILTER (wanted) / count(*) AS wanted_rate, count(DISTINCT source) AS sources, count(*) FILTER (source = prev) AS same_source,
  count(*) FILTER (key <> '') - count(DISTINCT key) FILTER (key <> '') AS repeated, count(*) FILTER (session = 0 AND page = 0 AND wanted) AS first_wanted, count(*) FILTER (age IS NULL) / count(*) AS undated FROM k GROUP BY 1),
t AS (SELECT persona, sum(n) AS top3 FROM (SELECT persona, source, count(*) AS n, row_number() OVER (PARTITION BY persona ORDER BY count(*) DESC, source) AS r FROM shown GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
d AS (SELECT persona, count(*) FILTER (NOT any_click) AS empty_sessions FROM (SELECT persona, session, bool_or(clicked) AS any_click FROM shown GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT persona, age, row_number() OVER (PARTITION BY persona ORDER BY age) - 1 AS r, count(*) OVER (PARTITION BY persona) AS n FROM shown WHERE age IS NOT NULL)
SELECT w.persona, shown, round(click_rate, 6) AS click_rate, round(wanted_rate, 6) AS wanted_rate, sources, same_source, repeated, first_wanted, round(undated, 6) AS undated, empty_sessions, round(top3 / shown, 6) AS top3_share, floor(age * 10 + 0.5) / 10 AS median_age
FROM w JOIN t USING (persona) JOIN d USING (persona) LEFT JOIN a ON a.persona = w.persona AND a.r = n // 2""",
    "items",
)
def feed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = met_items(spark, sf_dir).selectExpr("concat('p', user_id % 6) AS persona", "user_id div 6 AS session", "event_id % 3 AS page", "event_id AS ord", "event_type = 'click' AS clicked", "item_id AS id")
    age = F.when(F.col("id") % 9 > 0, hot.hours_between(F.expr(NOW), F.col("published_at")))
    shown = events.join(items(spark, sf_dir).select("id", "source", "title", F.col("category").isin("c1", "c2").alias("wanted"), age.alias("age")), "id")
    out = A.feed_quality(shown)
    return out.select("persona", "shown", "sources", "same_source", "repeated", "first_wanted", "empty_sessions", "median_age", *[F.round(c, 6).alias(c) for c in ("click_rate", "wanted_rate", "undated", "top3_share")])


@query("SELECT source, count(*) AS posts FROM items GROUP BY 1 HAVING count(*) >= 8", "items")
def eligible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with enough items for a page of their own."""
    return items(spark, sf_dir).groupBy("source").agg(F.count("*").alias("posts")).filter("posts >= 8")


@query(
    """WITH t AS (SELECT count(*) AS total FROM items WHERE source = 'src3')
SELECT 'item' AS what, CAST(id AS VARCHAR) AS key, score + comment_count AS n FROM (SELECT * FROM items WHERE source = 'src3' ORDER BY score + comment_count DESC, ord LIMIT 15)
UNION ALL SELECT 'category', category, count(*) FROM items WHERE source = 'src3' GROUP BY category UNION ALL SELECT 'total', '', total FROM t""",
    "items",
)
def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_parts(items(spark, sf_dir).filter("source = 'src3'"), 15, "category")


@query(
    """WITH h AS (SELECT *, list_contains(tags, 'ing') AS by_tag, contains(lower(title), 'ing') AS by_text FROM tagged), m AS (SELECT * FROM h WHERE by_tag OR (by_text AND NOT (SELECT bool_or(by_tag) FROM h)))
SELECT 'item' AS what, CAST(id AS VARCHAR) AS key, score + comment_count AS n FROM (SELECT * FROM m ORDER BY score + comment_count DESC, ord LIMIT 20)
UNION ALL SELECT 'category', category, count(*) FROM m GROUP BY category UNION ALL SELECT 'source', source, count(*) FROM m WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'total', '', count(*) FROM m""",
    "tagged",
)
def keyword_page_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword's page: items with the tag, or where no item has it those whose title holds it; with histograms."""
    from tidewell.sources.adapters import tagged_items

    return P.page_parts(P.keyword_rows(tagged_items(spark, sf_dir), "ing"), 20, "category", "source")


_EDITIONS = "e AS (SELECT CAST(published_at AS DATE) AS day, id % 97 AS story, source, score + 2 * comment_count AS hot, ord FROM items)"


def _period_rank(name: str, days: int):
    sql = f"""WITH {_EDITIONS}, d AS (SELECT day FROM (SELECT DISTINCT day FROM e) ORDER BY day DESC LIMIT {days}),
b AS (SELECT story, max(struct_pack(hot := hot, ord := -ord, source := source)) AS s FROM e WHERE day IN (SELECT day FROM d) GROUP BY story),
c AS (SELECT story, s.source AS source, s.hot AS hot, row_number() OVER (PARTITION BY s.source ORDER BY s.hot DESC, story) AS r FROM b),
t AS (SELECT story, source, hot, row_number() OVER (ORDER BY hot DESC, story) AS place FROM c WHERE r <= 2)
SELECT story, source, hot, place, CASE WHEN place <= 5 THEN '1-5' WHEN place <= 10 THEN '6-10' ELSE '11-20' END AS band FROM t WHERE place <= 20"""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = items(spark, sf_dir).selectExpr("to_date(published_at) AS day", "id % 97 AS story", "source", "score + 2 * comment_count AS hot", "ord")
        return P.period_top(rows, days, 2, 20)

    f.__name__ = name
    query(sql, "items")(f)


_period_rank("ranking_daily", 1)
_period_rank("ranking_monthly", 30)


@query(
    """WITH r AS (SELECT id, source, title, hot, ord, contains(title, 'eau') AS bad, row_number() OVER (PARTITION BY source ORDER BY hot DESC, ord) AS place FROM (SELECT *, score + 2 * comment_count AS hot FROM items WHERE source IS NOT NULL AND title IS NOT NULL))
SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bad, place) AS pick FROM r) WHERE pick = 1""",
    "items",
)
def lead_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that leads each source: its best whose title may stand in front, else its best."""
    rows = items(spark, sf_dir).filter("source is not null and title is not null").withColumn("hot", F.expr("score + 2 * comment_count"))
    best = F.min_by("id", F.struct(T.contains_any(F.col("title"), ["eau"]), -F.col("hot"), F.col("ord"))).alias("id")
    return rows.groupBy("source").agg(best)


@query(
    """WITH d AS (SELECT id, id % 11 = 0 AS ours, published_at, ord, round((0.35 + log10(1 + 3 * comment_count + 2 * score)) * pow(0.5, epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0 / 12), 6) AS rank FROM items)
SELECT id, row_number() OVER (ORDER BY ours DESC, CASE WHEN ours THEN published_at END DESC, CASE WHEN NOT ours THEN rank END DESC, ord) AS place FROM d ORDER BY place LIMIT 30 OFFSET 10""",
    "items",
)
def deals_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of deals from an offset: our own by time, then the others by their rank."""
    rows = hot.deal_rank(items(spark, sf_dir), F.expr(NOW)).withColumns({"ours": F.col("id") % 11 == 0, "deal_rank": F.round("deal_rank", 6)})
    order = [F.desc("ours"), F.when(F.col("ours"), F.col("published_at")).desc(), F.when(~F.col("ours"), F.col("deal_rank")).desc(), F.asc("ord")]
    page = rows.orderBy(*order).limit(40).select("id", *[c.alias(f"o{i}") for i, c in enumerate((F.col("ours"), F.col("ord")))], "published_at", "ours", "deal_rank", "ord")
    place = F.row_number().over(Window.orderBy(*order))
    return page.withColumn("place", place.cast("long")).filter("place > 10").select("id", "place")


@query(
    """WITH t AS (SELECT event_id, hour(ts + INTERVAL 9 HOUR) AS h, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - ts) / 60) AS m FROM events)
SELECT event_id, CASE WHEN h >= 5 AND h < 11 THEN 'morning' WHEN h >= 11 AND h < 17 THEN 'lunch' ELSE 'evening' END AS slot, CASE WHEN h >= 19 THEN 'evening' WHEN h >= 12 THEN 'lunch' WHEN h >= 7 THEN 'morning' END AS due,
  CASE WHEN m < 1 THEN '방금' WHEN m < 60 THEN CAST(m AS BIGINT) || '분' ELSE CAST(floor(m / 60 + 0.5) AS BIGINT) || '시간' END AS age FROM t"""
)
def hour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, due edition and age of every event."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    h = F.hour(F.col("ts") + F.expr("interval 9 hours"))
    minutes = F.floor((F.unix_micros(F.expr(NOW)) - F.unix_micros("ts")) / 60_000_000)
    return rows.select("event_id", D.slot_for_hour(h).alias("slot"), D.due_slot(h).alias("due"), D.age_label(minutes).alias("age"))


#: How list pages print the time of an event, by its id, and what can be told from it at midnight.
_PRINTED = """CASE event_id % 8 WHEN 0 THEN date_format(ts, 'HH:mm') WHEN 1 THEN date_format(ts, 'HH:mm:ss') WHEN 2 THEN date_format(ts, 'M-d HH:mm') WHEN 3 THEN concat(floor((unix_micros(TIMESTAMP '2024-01-31 00:00:00') - unix_micros(ts)) / 3600000000), '시간 전')
  WHEN 4 THEN date_format(ts, 'yy.MM.dd') WHEN 5 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 6 THEN concat(floor((unix_micros(TIMESTAMP '2024-01-31 00:00:00') - unix_micros(ts)) / 86400000000), '일') ELSE 'nonsense' END"""


@query(
    """WITH t AS (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - ts)) AS BIGINT) AS s FROM events),
c AS (SELECT *, CASE event_id % 8 WHEN 0 THEN date_trunc('minute', ts) - date_trunc('day', ts) ELSE date_trunc('second', ts) - date_trunc('day', ts) END AS clock FROM t),
a AS (SELECT event_id, CASE WHEN event_id % 8 < 2 THEN CASE WHEN clock <= INTERVAL 1 MINUTE THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-30 00:00:00' END + clock ELSE CASE event_id % 8
  WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(s // 3600) WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('second', ts) WHEN 6 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(s // 86400 AS INTEGER)) END END AS moment FROM c)
SELECT event_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS "at" FROM a"""
)
def list_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events read again from what list pages print of them; the tests hold the forms that no event has."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("label", F.expr(_PRINTED))
    return rows.select("event_id", F.date_format(D.list_time(F.col("label"), F.expr(NOW)), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """SELECT p_partkey AS id, CASE WHEN n >= 10000 THEN regexp_replace(CAST(floor(n / 1000 + 0.5) / 10 AS VARCHAR), '\\.0$', '') || '만' ELSE format('{:,}', n) END AS count,
  CASE p_partkey % 6 WHEN 0 THEN '홈' WHEN 1 THEN '키워드' WHEN 2 THEN '브리핑' WHEN 3 THEN '/x/' || p_partkey WHEN 4 THEN '기타' ELSE '딜' END AS view,
  CASE p_partkey % 3 WHEN 0 THEN '은' WHEN 1 THEN '는' ELSE '는' END AS josa, p_partkey % 4 = 1 AS korean FROM (SELECT *, p_partkey * p_size AS n FROM part)"""
)
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as the Korean page prints them, kinds of pages, particles and whether a text is Korean."""
    path = F.expr("CASE p_partkey % 6 WHEN 0 THEN '/?a=1' WHEN 1 THEN concat('/keyword/', p_partkey) WHEN 2 THEN '/briefing' WHEN 3 THEN concat('/x/', p_partkey) WHEN 4 THEN '' ELSE '/deals?x' END")
    word = F.expr("element_at(array('삼성', '사과', 'abc'), int(p_partkey % 3 + 1))")
    text = F.expr("element_at(array('plain', 'a 가 b', 'x', 'é'), int(p_partkey % 4 + 1))")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), T.format_count(F.col("p_partkey") * F.col("p_size")).alias("count"), T.view_label(path).alias("view"), T.josa(word, "은", "는").alias("josa"), T.has_korean(text).alias("korean")
    )


_NOTE = """WITH s AS (SELECT source, avg(score) AS mean, count(*) AS n FROM items GROUP BY 1), v AS (SELECT i.*, s.mean, s.n, epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 60.0 AS mins, CASE WHEN i.id % 20 = 0 THEN 0 ELSE 9 END AS place, score * 4 AS sc FROM items i JOIN s USING (source))
SELECT id, CASE WHEN mins <= 1440 AND (sc >= 300 OR comment_count >= 300) THEN 'surge' WHEN mean * 4 > 0 AND n >= 2 AND sc > 0 AND sc / (mean * 4) >= 1.9 THEN 'outlier' WHEN place = 0 AND (sc > 0 OR comment_count > 0) THEN 'first' WHEN comment_count >= 30 AND comment_count >= sc * 3 THEN 'debate'
  WHEN mins <= 30 AND (sc > 0 OR comment_count > 0) THEN 'fresh' WHEN id % 3 = 1 AND summary <> '' THEN 'translated' WHEN coverage >= 3 THEN 'coverage' WHEN place <= 2 AND mins <= 30 THEN 'top' ELSE 'none' END AS note FROM v"""


@query(_NOTE, "items")
def editorial_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which note an editor's rules put beside an item, the first that holds."""
    rows = items(spark, sf_dir).withColumns({"score": F.col("score") * 4, "source_rank": F.expr("if(id % 20 = 0, 0, 9)"), "translated": F.col("id") % 3 == 1})
    return P.editorial_notes(rows, F.expr(NOW), multiple=1.9).select("id", F.col("note"))


@query(
    """WITH v AS (SELECT id, category, source, ord, score, comment_count, coverage, CASE WHEN contains(lower(title), 'tion') THEN 600 ELSE 0 END AS traffic FROM items),
w AS (SELECT *, score + 2 * comment_count + 50 * coverage + 250 * least(1, traffic / CAST(1000 AS DOUBLE)) * 0.6 + CASE WHEN category IN ('c1', 'c2') THEN 105 ELSE 0 END AS weight FROM v)
SELECT id, source, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, ord) AS r FROM w) WHERE r <= 6 ORDER BY w.weight DESC, ord LIMIT 60""".replace("w.weight", "weight"),
    "items",
)
def briefing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("traffic", F.when(F.lower("title").contains("tion"), 600).otherwise(0))
    rows = rows.withColumn("weight", P.briefing_weight(F.col("traffic"), F.lit(0.6), F.col("category").isin("c1", "c2")))
    best = hot.capped_top(rows, 6, 60, order=(F.desc("weight"), F.asc("ord")))
    return best.select("id", "source", F.round("weight", 6).alias("weight"))


@query("SELECT source, CAST(min(CAST(published_at AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(published_at AS DATE)) AS VARCHAR) AS last, count(DISTINCT CAST(published_at AS DATE)) AS days FROM items GROUP BY 1", "items")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("published_at")
    return items(spark, sf_dir).groupBy("source").agg(F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last"), F.countDistinct(day).alias("days"))


@query(
    """WITH w AS (SELECT category, source, CAST(published_at AS DATE) AS day FROM items), d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS back FROM (SELECT DISTINCT day FROM w)), k AS (SELECT w.*, back FROM w JOIN d USING (day) WHERE back <= 7)
SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY 1""",
    "items",
)
def weekly_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    week = P.landscape(rows, "category", 7).select("category", "n")
    total = F.broadcast(week.agg(F.sum("n").alias("all")))
    return week.crossJoin(total).select("category", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(
    """SELECT user_id, count(*) AS liked, round(avg(i.score), 6) AS mean FROM signals s JOIN items i ON i.id = s.item_id WHERE signal > 0 GROUP BY 1""", "signals", "items"
)
def liked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).filter("signal > 0").join(items(spark, sf_dir).select(F.col("id").alias("item_id"), "score"), "item_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("liked"), F.round(F.avg("score"), 6).alias("mean"))



@query(
    """WITH m AS (SELECT id // 4 AS issue, id % 4 AS place, title FROM items WHERE id % 4 < 3), w AS (SELECT issue, place, unnest(regexp_split_to_array(title, '[^가-힣a-zA-Z0-9]+')) AS w, generate_subscripts(regexp_split_to_array(title, '[^가-힣a-zA-Z0-9]+'), 1) AS pos FROM m),
o AS (SELECT issue, place, w, min(pos) AS pos FROM w WHERE length(w) >= 2 GROUP BY ALL), c AS (SELECT issue, w, count(*) AS n, min(struct_pack(p := place, a := pos)) AS first FROM o GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY n DESC, first) AS r FROM c)
SELECT issue, string_agg(w, ' ' ORDER BY r) AS subject FROM r WHERE r <= 2 GROUP BY 1""",
    "items",
)
def issue_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each four items in a row are called by, where their titles share a word; the tests hold the phrase taken otherwise."""
    members = items(spark, sf_dir).filter("id % 4 < 3").selectExpr("id div 4 AS issue", "id % 4 AS place", "title")
    named = P.issue_subjects(members, ["issue"])
    told = members.select("issue", "place", F.explode(F.array_distinct(F.split("title", "[^가-힣a-zA-Z0-9]+"))).alias("w")).filter("length(w) >= 2").groupBy("issue", "w").agg(F.count("*").alias("n")).filter("n >= 2")
    return named.join(told.select("issue").distinct(), "issue", "left_semi")


@query(
    f"""WITH a AS ({_ADS}), v AS (SELECT *, 'd' || (event_id % 3) || '_c' || (event_id % 2) || '_' || (event_id % 4) AS cell FROM a),
c AS (SELECT cell, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM v GROUP BY 1),
s AS (SELECT *, (click + (sum(click) OVER () / sum(imp) OVER ()) * 30) / (imp + 30) AS score FROM c), w AS (SELECT * FROM s WHERE imp >= 20 ORDER BY round(score, 9) DESC, cell LIMIT 8)
SELECT split_part(cell, '_', 1) AS dest, 'hook ' || cell AS hook, floor(score * 10000 + 0.5) / 100 AS ctr FROM w WHERE split_part(cell, '_', 3) <> '3'""",
    "track",
)
def winning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best variants with the lines that a matrix of copy holds for them; cells that it lacks go."""
    cell = F.expr("concat('d', event_id % 3, '_c', event_id % 2, '_', event_id % 4)")
    best = A.variant_scores(_ads(spark, sf_dir).withColumn("variant", cell)).filter("imp >= 20").withColumn("place", F.round("score", 9)).orderBy(F.desc("place"), "variant").limit(8)
    grid = spark.range(18).selectExpr("concat('d', id div 6) AS dest", "concat('c', id div 3 % 2) AS ctx", "id % 3 AS idx")
    matrix = grid.selectExpr("dest", "ctx", "idx", "concat('hook ', dest, '_', ctx, '_', idx) AS hook")
    return A.variant_lines(best, matrix).select("dest", "hook", "ctr")


@query(
    """WITH k AS (SELECT CAST(user_id AS VARCHAR) AS u, min(event_id) AS first, count(*) AS n FROM track GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first) AS r FROM k) SELECT u AS key, n FROM r WHERE r <= 120""",
    "track",
)
def cardinality_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.kept_keys(track_events(spark, sf_dir).withColumn("u", F.col("user_id").cast("string")), "u", "event_id")
