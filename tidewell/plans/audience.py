"""Queries of product analytics, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.dates import kst_day
from tidewell.operators import audience as A
from tidewell.plans.base import Catalogue
from tidewell.sources.adapters import NOW, items, registry, table, track_events

CATALOGUE = Catalogue()
query = CATALOGUE.query

_METRICS = """count(*) FILTER (type = 'view') AS pv, count(*) FILTER (type = 'view' AND entry) AS sessions, count(DISTINCT user_id) AS visitors,
 CAST(coalesce(sum(dwell_ms) FILTER (type = 'exit' AND dwell_ms > 0 AND dwell_ms <= 7200000), 0) AS BIGINT) AS dwell_ms,
 count(*) FILTER (type = 'exit' AND dwell_ms > 0 AND dwell_ms <= 7200000) AS dwell_n,
 CAST(coalesce(sum(k) FILTER (type = 'exit' AND k >= 0 AND k <= 2000), 0) AS BIGINT) AS depth, count(*) FILTER (type = 'exit' AND k >= 0 AND k <= 2000) AS depth_n,
 count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type = 'ad_impression') AS ad_imp, count(*) FILTER (type = 'ad_click') AS ad_click"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_events(spark, sf_dir).withColumn("depth", F.col("k"))


@query(
    f"""WITH m AS (SELECT day, {_METRICS} FROM track GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, pv, sessions, visitors, clicks, ad_click, dwell_ms, dwell_n, depth, depth_n,
  floor(pv / visitors * 10 + 0.5) / 10 AS pv_per_visitor,
  CASE WHEN dwell_n > 0 THEN floor(dwell_ms / dwell_n / 1000 + 0.5) END AS avg_dwell_s,
  CASE WHEN depth_n > 0 THEN floor(depth / depth_n * 10 + 0.5) / 10 END AS avg_depth FROM m""",
    "track",
)
def metrics_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.summaries(A.metrics(_events(spark, sf_dir), "day"))
    names = ["pv", "sessions", "visitors", "clicks", "ad_click", "dwell_ms", "dwell_n", "depth", "depth_n", "pv_per_visitor", "avg_dwell_s", "avg_depth"]
    return rows.select(F.col("day").cast("string").alias("day"), *names)


def _series(grain: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir).withColumn("period", A.period(F.col("day"), grain).cast("string"))
        return A.metrics(rows, "period").select("period", "pv", "sessions", "visitors", "clicks", "ad_click", "dwell_n")

    f.__name__ = f"metrics_series_{grain}"
    return f


for _grain, _key in (("week", "CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR)"), ("month", "strftime(day, '%Y-%m')")):
    query(f"SELECT {_key} AS period, count(*) FILTER (type = 'view') AS pv, count(*) FILTER (type = 'view' AND entry) AS sessions, count(DISTINCT user_id) AS visitors, count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type = 'ad_click') AS ad_click, count(*) FILTER (type = 'exit' AND dwell_ms > 0 AND dwell_ms <= 7200000) AS dwell_n FROM track GROUP BY 1", "track")(_series(_grain))


@query(
    """SELECT CAST(day AS VARCHAR) AS day, type, count(*) AS n, CAST(grouping(day, type) AS BIGINT) AS level
FROM track GROUP BY GROUPING SETS ((day, type), (day), (type), ())""",
    "track",
)
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = track_events(spark, sf_dir).cube("day", "type").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return cube.select(F.col("day").cast("string").alias("day"), "type", "n", "level")


@query(
    """WITH d AS (SELECT DISTINCT user_id, day FROM track), f AS (SELECT user_id, min(day) AS first FROM d GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS visitors, count(*) FILTER (day = first) AS new, count(*) - count(*) FILTER (day = first) AS returning
FROM d JOIN f USING (user_id) GROUP BY 1""",
    "track",
)
def uniques_new_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.new_and_returning(track_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH p AS (SELECT 'type' AS dim, type AS key FROM track UNION ALL SELECT 'k', CAST(k AS VARCHAR) FROM track
  UNION ALL SELECT 'decade', CAST(k // 10 * 10 + 1 AS VARCHAR) || '~' || CAST(k // 10 * 10 + 10 AS VARCHAR) FROM track WHERE k >= 0),
c AS (SELECT dim, key, count(*) AS n FROM p WHERE key IS NOT NULL AND key <> '' GROUP BY ALL)
SELECT * FROM (SELECT dim, key, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS place FROM c) WHERE place <= 10""",
    "track",
)
def metrics_dim_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"type": F.col("type"), "k": F.col("k"), "decade": A.rank_decade(F.col("k"))}
    return A.top_keys(A.dimension_counts(track_events(spark, sf_dir), dims), 10).withColumn("place", F.col("place").cast("long"))


@query(
    """WITH k AS (SELECT CAST(user_id AS VARCHAR) AS u, min(event_id) AS first, count(*) AS n FROM track GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY first) AS r FROM k)
SELECT CASE WHEN r <= 120 THEN u ELSE '기타' END AS key, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""",
    "track",
)
def cardinality_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fold_keys(track_events(spark, sf_dir).withColumn("u", F.col("user_id").cast("string")), "u", "event_id")


_ADS = "SELECT event_id, day, CASE WHEN type = 'view' THEN 'ad_impression' ELSE type END AS type, 's' || (k % 5) AS slot, 'v' || (event_id % 23) AS variant, user_id FROM track WHERE type IN ('view', 'ad_click')"


def _ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_events(spark, sf_dir).filter("type in ('view', 'ad_click')").selectExpr(
        "event_id", "day", "if(type = 'view', 'ad_impression', type) AS type", "concat('s', k % 5) AS slot", "concat('v', event_id % 23) AS variant", "user_id"
    )


@query(
    f"""WITH a AS ({_ADS}), c AS (SELECT slot, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM a GROUP BY 1)
SELECT slot, imp, click, CASE WHEN imp > 0 THEN floor(100 * (click / imp) * 100 + 0.5) / 100 END AS ctr FROM c""",
    "track",
)
def ad_slot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ad_slots(_ads(spark, sf_dir))


@query(
    f"""WITH a AS ({_ADS}), c AS (SELECT variant, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM a GROUP BY 1)
SELECT variant, imp, click, round(click / imp, 4) AS ctr, round((click + (sum(click) OVER () / sum(imp) OVER ()) * 30) / (imp + 30), 5) AS score FROM c""",
    "track",
)
def variant_shrunk_ctr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.variant_scores(_ads(spark, sf_dir)).select("variant", "imp", "click", F.round("ctr", 4).alias("ctr"), F.round("score", 5).alias("score"))


@query(
    f"""WITH a AS ({_ADS}), c AS (SELECT variant, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click FROM a GROUP BY 1)
SELECT variant, imp, click FROM c WHERE imp >= 20 ORDER BY (click + (SELECT sum(click) / sum(imp) FROM c) * 30) / (imp + 30) DESC, variant LIMIT 8""",
    "track",
)
def winning_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = A.variant_scores(_ads(spark, sf_dir)).filter("imp >= 20").orderBy(F.desc("score"), "variant").limit(8)
    return best.select("variant", "imp", "click")


@query(
    f"""WITH a AS ({_ADS})
SELECT CASE WHEN regexp_matches(slot, '^s[01]') THEN 'house' ELSE 'network' END AS grp, count(*) FILTER (type = 'ad_impression') AS imp, count(*) FILTER (type = 'ad_click') AS click,
  floor(100.0 * count(*) FILTER (type = 'ad_click') / count(*) FILTER (type = 'ad_impression') * 100 + 0.5) / 100 AS ctr
FROM a GROUP BY 1""",
    "track",
)
def ad_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ads(spark, sf_dir).withColumn("slot", F.when(F.col("slot").rlike("^s[01]"), "house").otherwise("network"))
    return A.ad_slots(rows).withColumnRenamed("slot", "grp")


_CALLS = """SELECT CAST(o_orderdate AS DATE) AS day, 'm' || (o_orderkey % 5) AS model, o_orderstatus AS purpose, o_orderkey % 4000 AS in_tok, o_custkey % 900 AS out_tok FROM orders"""
_PRICES = "SELECT * FROM (VALUES ('m0', 0.5, 1.5), ('m1', 1.0, 3.0), ('m2', 3.0, 15.0), ('m3', 0.25, 1.25)) t(model, in_price, out_price)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("to_date(o_orderdate) AS day", "concat('m', o_orderkey % 5) AS model", "o_orderstatus AS purpose", "o_orderkey % 4000 AS in_tok", "o_custkey % 900 AS out_tok")


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("m0", 0.5, 1.5), ("m1", 1.0, 3.0), ("m2", 3.0, 15.0), ("m3", 0.25, 1.25)], "model string, in_price double, out_price double")


@query(
    f"""WITH c AS ({_CALLS}), p AS ({_PRICES}),
u AS (SELECT strftime(day, '%Y-%m') AS day, model, purpose, in_tok, out_tok, CAST(in_tok AS DECIMAL(18, 0)) * CAST(in_price AS DECIMAL(8, 2)) + CAST(out_tok AS DECIMAL(18, 0)) * CAST(out_price AS DECIMAL(8, 2)) AS micro FROM c LEFT JOIN p USING (model))
SELECT day, model, purpose, count(*) AS calls, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok, coalesce(CAST(sum(micro) AS DOUBLE) / 1e6, 0) AS usd, count(*) FILTER (micro IS NULL) AS unpriced
FROM u GROUP BY GROUPING SETS ((day), (day, model), (day, purpose))"""
)
def llm_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM"))
    return A.call_costs(calls, _prices(spark))


@query(
    f"""WITH c AS ({_CALLS}), p AS ({_PRICES}),
d AS (SELECT day, coalesce(sum(CAST(in_tok AS DECIMAL(18, 0)) * CAST(in_price AS DECIMAL(8, 2)) + CAST(out_tok AS DECIMAL(18, 0)) * CAST(out_price AS DECIMAL(8, 2))), 0) AS micro FROM c LEFT JOIN p USING (model) GROUP BY day),
m AS (SELECT strftime(day, '%Y-%m') AS month, CAST(sum(micro) AS DOUBLE) / 1e6 AS usd, CAST(count(*) AS DOUBLE) / any_value(day(last_day(day))) AS share FROM d GROUP BY 1),
f AS (SELECT month, CASE WHEN right(month, 2) <> '02' THEN 90000.0 END AS fixed_krw, CASE WHEN right(month, 2) IN ('01', '06') THEN 200000.0 END AS revenue, usd, share FROM m)
SELECT month, floor(usd * 1400 + 0.5) AS variable, floor(coalesce(fixed_krw, 0) * share + 0.5) AS fixed, CAST(revenue AS DOUBLE) AS revenue, fixed_krw IS NULL AS missing,
  CAST(revenue - floor(usd * 1400 + 0.5) - floor(coalesce(fixed_krw, 0) * share + 0.5) AS DOUBLE) AS net FROM f"""
)
def pnl_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.call_costs(_calls(spark, sf_dir), _prices(spark)).filter("model is null and purpose is null").select("day", "usd")
    months = daily.select(F.date_format("day", "yyyy-MM").alias("month")).distinct()
    fixed = months.filter("right(month, 2) != '02'").selectExpr("month", "90000.0D AS krw")
    revenue = months.filter("right(month, 2) in ('01', '06')").selectExpr("month", "200000.0D AS revenue")
    return A.profit(daily, fixed, revenue, 1400.0)


@query(
    """WITH s AS (SELECT source, count(*) AS items, count(*) FILTER (score + comment_count > 0) AS with_signal FROM items WHERE source <> 'src6' GROUP BY 1),
m AS (SELECT r.source, r.no, coalesce(items, 0) AS items, coalesce(with_signal, 0) AS with_signal FROM registry r LEFT JOIN s USING (source) WHERE enabled)
SELECT source, items, with_signal, CASE WHEN items = 0 THEN CASE WHEN no % 2 = 0 THEN 'stalled' ELSE 'down' END WHEN with_signal > 0 THEN 'ok' WHEN no % 2 = 1 THEN 'signal-lost' ELSE 'no-signal' END AS status FROM m""",
    "items",
    "registry",
)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = registry(spark, sf_dir).withColumn("expects_signal", F.lit(True))
    state = known.selectExpr("source", f"if(no % 2 = 0, {NOW} - interval 2 hours, {NOW} - interval 3 days) AS last_items", f"if(no % 2 = 1, {NOW} - interval 4 days, null) AS last_signal")
    rows = A.source_health(known, items(spark, sf_dir).filter("source != 'src6'"), state, F.expr(NOW))
    return rows.select("source", "items", "with_signal", "status")


@query(
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS trailing FROM events"
)
def trailing_actions_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return A.trailing_count(rows, "user_id", "ts", 600).select("event_id", "trailing")


_LAST = """WITH e AS (SELECT user_id, event_id % 200 AS item_id, {f}(event_id) AS lastat FROM events GROUP BY ALL)
SELECT * FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY lastat DESC) AS place FROM e) WHERE place <= 20"""


def _last(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id % 200 AS item_id", "event_id AS ord")
    return A.last_distinct(rows, "user_id", "item_id", 20, first).select("user_id", "item_id", F.col("place").cast("long").alias("place"))


@query(_LAST.format(f="min"))
def last_n_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(spark, sf_dir, True)


@query(_LAST.format(f="max"))
def mru_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(spark, sf_dir, False)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1")
def minute_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ord", F.col("event_id"))
    return A.minute_limit(rows, "event_type", "ts", 1).select("event_id")


@query("SELECT conv_id, count(*) AS rows, count(*) FILTER (role = prev) AS same FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.runs_of_same(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


_REF = """CASE WHEN host IS NULL THEN '직접 유입' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN '내부 이동' ELSE left(regexp_replace(host, '^www\\.', ''), 60) END"""


@query(
    f"""WITH h AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host FROM pages)
SELECT {_REF} AS label, count(*) AS n FROM h GROUP BY 1"""
)
def referrer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(T.referrer_label(F.col("url"), "example.net").alias("label")).agg(F.count("*").alias("n"))


@query(
    r"""WITH q AS (SELECT page_id, regexp_extract(url, 'utm_source=([^&#]*)', 1) AS s, regexp_extract(url, 'utm_medium=([^&#]*)', 1) AS m FROM pages)
SELECT page_id, CASE WHEN s <> '' OR m <> '' THEN (CASE WHEN s = '' THEN '-' ELSE s END) || ' | ' || (CASE WHEN m = '' THEN '-' ELSE m END) || ' | -' END AS campaign FROM q"""
)
def campaign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_ = F.regexp_extract("url", r"\?([^#]*)", 1)
    params = F.str_to_map(query_, F.lit("&"), F.lit("="))
    return table(spark, sf_dir, "pages").select("page_id", T.campaign_key(F.when(query_ != "", params).otherwise(F.create_map().cast("map<string,string>"))).alias("campaign"))


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS visitors, true AS near FROM events GROUP BY 1")
def uniques_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact visitors of each day, and whether its mergeable sketch is within 5 % of them, three of its standard errors."""
    rows = table(spark, sf_dir, "events").select(kst_day(F.col("ts").cast("timestamp")).alias("day"), "user_id")
    both = rows.groupBy("day").agg(F.countDistinct("user_id").alias("visitors")).join(rows.groupBy("day").agg(F.hll_sketch_agg("user_id").alias("s")), "day")
    off = F.abs(F.hll_sketch_estimate("s") - F.col("visitors"))
    return both.select(F.col("day").cast("string").alias("day"), "visitors", (off <= F.greatest(F.lit(1.0), 0.05 * F.col("visitors"))).alias("near"))


@query()
def uniques_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's visitors as its mergeable sketch estimates them; no SQL gives the same estimate."""
    rows = table(spark, sf_dir, "events").select(kst_day(F.col("ts").cast("timestamp")).alias("day"), "user_id")
    sketches = rows.groupBy("day").agg(F.hll_sketch_agg("user_id").alias("s"))
    return sketches.select(F.col("day").cast("string").alias("day"), F.hll_sketch_estimate("s").alias("visitors"))
