"""Queries that run a streaming job over whole tables to the end, with the SQL of the same batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import classify as K
from tidewell.plans.base import Catalogue
from tidewell.plans.classify import _FEATS
from tidewell.plans.feeds import described
from tidewell.plans.taste import LEARNT_SQL, learning_events
from tidewell.sources import feeds as S
from tidewell.sources.adapters import NOW, items, table, tagged_items
from tidewell.streaming import jobs as J
from tidewell.streaming import stateful as P
from tidewell.streaming.delivery import DigestSweep, Editions
from tidewell.streaming.store import in_batches, scratch
from tidewell.streaming.tables import BoundedTable, CountLedger, DayCounts, EnrichmentQueue

CATALOGUE = Catalogue()
query = CATALOGUE.query

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.file_stream(spark, f"{sf_dir}/events.parquet*", _SCHEMA)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("type"), "value")


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.drained(spark, J.day_counts(events(spark, sf_dir)), "complete")
    return rows.select(F.col("day").cast("string").alias("day"), "type", "n")


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def stream_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.drained(spark, J.day_visitors(events(spark, sf_dir)), "append")
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("visitors"))


@query(
    """WITH w AS (SELECT user_id, to_timestamp(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - k * 300) AS start FROM events, (VALUES (0), (1)) t(k))
SELECT user_id, count(*) AS windows, CAST(sum(n * n) AS BIGINT) AS squares FROM (SELECT user_id, start, count(*) AS n FROM w GROUP BY ALL) GROUP BY 1"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten minutes each five, by how many there are for a reader and the sum of their squared counts."""
    rows = J.drained(spark, J.sliding_counts(events(spark, sf_dir)), "complete")
    return rows.groupBy("user_id").agg(F.count("*").alias("windows"), F.sum(F.col("n") * F.col("n")).alias("squares"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)
SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY 1"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.drained(spark, J.session_counts(events(spark, sf_dir), "6 hours"), "complete")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT event_id % 300 AS id, count(*) AS met FROM (SELECT DISTINCT event_id % 300 AS event_id FROM events) GROUP BY 1")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.drained(spark, J.learnt_once(events(spark, sf_dir).select((F.col("event_id") % 300).alias("id"))), "append")
    return rows.groupBy("id").agg(F.count("*").alias("met"))


@query(
    """WITH r AS (SELECT user_id % 40 AS id, event_id, value, ts FROM events), l AS (SELECT id, list(value ORDER BY ts) AS v, min(ts) AS first, max(ts) AS last FROM r GROUP BY 1)
SELECT id, round(list_reduce(v, lambda a, b: CASE WHEN b >= a THEN b ELSE 0.7 * a + 0.3 * b END), 6) AS score, CAST(date_trunc('second', first) AS VARCHAR) AS first_seen, CAST(date_trunc('second', last) AS VARCHAR) AS last_seen FROM l"""
)
def stream_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling pool after all ticks, with a keeping time that none outlives."""
    ticks = events(spark, sf_dir).select((F.col("user_id") % 40).alias("id"), F.col("value").alias("score"), F.lit(None).cast("string").alias("image"), "ts", "event_id")
    rows = J.drained(spark, J.rolling_pool(ticks, kept_hours=24 * 60, ties=("event_id",)), "update").filter("alive")
    last = rows.groupBy("id").agg(F.max_by(F.struct("score", "first_seen", "last_seen"), "last_seen").alias("s"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return last.select("id", F.round("s.score", 6).alias("score"), stamp("s.first_seen").alias("first_seen"), stamp("s.last_seen").alias("last_seen"))


#: Batches into which the queries below cut a table, each read after the one before.
BATCHES = 4
CLOCK = dt.datetime(2024, 1, 31)


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(LEARNT_SQL, "tagged")
def stream_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every reader after a stream of all events, moved in state one event after the other."""
    folder = scratch(spark, "preferences")
    told = learning_events(spark, sf_dir).select("user_id", "id", "ord", "step")
    stream = in_batches(told, "ord", BATCHES, f"{folder}/in")
    # read by every batch, so texts are only gone through once
    tagged_items(spark, sf_dir).select("id", "category", "source", "tags", "words").write.parquet(f"{folder}/items")
    updates = J.drained(spark, P.preference_updates(P.moves(stream, spark.read.parquet(f"{folder}/items"))), "update")
    return P.current_weights(updates).withColumn("weight", F.round("weight", 6))


@query("SELECT event_id, user_id, event_type AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 2,000 events, kept by number as batches come in."""
    folder = scratch(spark, "log")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type AS type", "cast(ts AS timestamp) AS ts")
    log = BoundedTable(spark, f"{folder}/log", "ts", ties=["event_id"], most=2000)
    J.run_batches(in_batches(rows, "event_id", BATCHES, f"{folder}/in"), "append", log.update, f"{folder}/checkpoint")
    return log.rows().select("event_id", "user_id", "type")


@query(
    """WITH v AS (SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS visitor, max(ts) AS last, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1)
SELECT visitor, event_id FROM v ORDER BY last DESC, event_id DESC LIMIT 1000"""
)
def bounded_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,000 visitors seen last with their last event: one that went comes back when it is seen again."""
    folder = scratch(spark, "visitors")
    rows = table(spark, sf_dir, "events").selectExpr("user_id * 100 + cast(get_json_object(props, '$.k') AS bigint) AS visitor", "event_id", "cast(ts AS timestamp) AS ts")
    seen = BoundedTable(spark, f"{folder}/seen", "ts", key=["visitor"], ties=["event_id"], most=1000)
    J.run_batches(in_batches(rows, "event_id", BATCHES, f"{folder}/in"), "append", seen.update, f"{folder}/checkpoint")
    return seen.rows().select("visitor", "event_id")


@query(
    """WITH r AS (SELECT user_id * 10 + event_id % 10 AS id, ts FROM events), l AS (SELECT id, list_reduce(list(ts ORDER BY ts), lambda w, t: CASE WHEN t - w > INTERVAL 7 DAY THEN t ELSE w END) AS first, max(ts) AS last FROM r GROUP BY 1)
SELECT id, strftime(first, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_seen FROM l WHERE first >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"""
)
def bounded_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When ids were first seen, for seven days: later they go, and begin anew where they come back."""
    folder = scratch(spark, "first-seen")
    rows = table(spark, sf_dir, "events").selectExpr("user_id * 10 + event_id % 10 AS id", "cast(ts AS timestamp) AS ts")
    seen = BoundedTable(spark, f"{folder}/seen", "ts", key=["id"], days=7, by_first=True)
    J.run_batches(in_batches(rows, "ts", BATCHES, f"{folder}/in"), "append", seen.update, f"{folder}/checkpoint")
    return seen.rows().select("id", _stamp("first_at").alias("first_seen"), _stamp("ts").alias("last_seen"))


@query(f"""WITH e AS (SELECT lang AS label, unnest({_FEATS}) AS feature FROM items WHERE lang IS NOT NULL AND len({_FEATS}) >= 2) SELECT label, feature, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY ALL""", "items")
def stream_nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's counts after a stream of all documents in which each batch comes twice, the second time under the same number."""
    folder = scratch(spark, "ledger")
    rows = items(spark, sf_dir).select("id", F.col("lang").alias("label"), "title")
    ledger = CountLedger(spark, f"{folder}/ledger", "label string, feature string, w double", ["label", "feature"])

    def counts(docs: DataFrame) -> DataFrame:
        return K.feature_counts(docs.select("id", "label", T.title_features(F.col("title")).alias("features"), F.lit(1.0).alias("weight")))

    def learn(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            ledger.learn(batch, number, counts)

    J.run_batches(in_batches(rows, "id", BATCHES, f"{folder}/in"), "append", learn, f"{folder}/checkpoint")
    return ledger.totals()


@query(
    """WITH d AS (SELECT DISTINCT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL),
v AS (SELECT day, count(*) AS visitors, count(*) FILTER (day = DATE '2024-01-01' + CAST(user_id % 30 AS INTEGER)) AS fresh FROM d GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, visitors, least(visitors, 100) AS counted, visitors - least(visitors, 100) AS over, fresh, greatest(0, least(visitors, 100) - fresh) AS returning FROM v"""
)
def stream_new_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and returning readers of each day, with a cap of 100 a day."""
    folder = scratch(spark, "days")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts", "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(int(user_id % 30)) AS created_at")
    days = DayCounts(spark, f"{folder}/days", cap=100)
    J.run_batches(P.day_visits(in_batches(rows, "event_id", BATCHES, f"{folder}/in")), "append", days.add, f"{folder}/checkpoint")
    return days.days().withColumn("day", F.col("day").cast("string"))


_FRESH = ["event_id * 7 % 50", "50 + event_id * 11 % 50", "100 + event_id * 13 % 50", "150 + event_id % 50"]


@query(
    f"""WITH RECURSIVE q AS (SELECT user_id, event_id, ts FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT user_id, event_id, epoch_ms(ts) // 60000 // 4320 * 4320 * 60000 + epoch_ms(ts) % 1200000 AS moment, [{", ".join(_FRESH)}] AS fresh, CASE WHEN event_id % 4 = 0 THEN [event_id * 7 % 50] ELSE [] END AS gone FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS n FROM r),
s(user_id, n, request, ids, since, pinned, opened) AS (
  SELECT user_id, n, event_id, fresh[1:3], moment, CAST([] AS BIGINT[]), true FROM o WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, page[1:3], CASE WHEN len(list_intersect(page[1:3], ids)) > 0 THEN since ELSE moment END, pinned, len(list_intersect(page[1:3], ids)) = 0
  FROM (SELECT o.user_id, o.n, o.event_id, o.moment, s.ids, s.since, p.pinned, list_concat(p.pinned, list_filter(o.fresh, lambda f: NOT list_contains(p.pinned, f))) AS page
        FROM o JOIN s ON o.user_id = s.user_id AND o.n = s.n + 1, LATERAL (SELECT CASE WHEN o.moment - s.since <= 900000 THEN list_filter(s.ids, lambda i: NOT list_contains(o.gone, i)) ELSE CAST([] AS BIGINT[]) END AS pinned) p))
SELECT user_id, request, array_to_string(pinned, ',') AS pinned, array_to_string(ids, ',') AS first, opened FROM s"""
)
def home_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each home page of each reader keeps in place, from requests that come in bursts."""
    folder = scratch(spark, "anchors")
    at = "unix_millis(cast(ts AS timestamp)) div 60000 div 4320 * 4320 * 60000 + unix_millis(cast(ts AS timestamp)) % 1200000"
    rows = table(spark, sf_dir, "events").filter("event_type in ('view', 'click')").selectExpr(
        "user_id", "event_id AS request", f"{at} AS at", f"array({', '.join(_FRESH)}) AS fresh", "if(event_id % 4 = 0, array(event_id * 7 % 50), array()) AS gone"
    )
    screens = P.first_screens(in_batches(rows.filter("user_id is not null"), "at", BATCHES, f"{folder}/in"))
    pages = J.drained(spark, screens, "append").select("user_id", "request", "pinned", "page", "opened")
    # of requests without a reader the SQL knows the first alone: no page follows on it
    lone = rows.filter("user_id is null").agg(F.min_by(F.struct("user_id", "request", "fresh"), F.struct("at", "request")).alias("r")).filter("r is not null")
    pages = pages.union(lone.select("r.user_id", "r.request", F.expr("cast(array() AS array<bigint>)"), "r.fresh", F.lit(True)))
    return pages.select("user_id", "request", F.array_join("pinned", ",").alias("pinned"), F.array_join(F.slice("page", 1, P.PINS), ",").alias("first"), "opened")


#: What the pages tell of themselves when they are fetched.
_TOLD_PAGES = """w AS (SELECT url, arg_min(CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/i/' || page_id || '.png' WHEN 1 THEN regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/big/' || page_id || '.jpg'
    WHEN 2 THEN 'https://img.youtube.com/vi/abcdefghijk/hqdefault.jpg' ELSE '' END, page_id) AS image, arg_min(CASE WHEN page_id % 5 = 0 THEN 'a description of page ' || page_id ELSE '' END, page_id) AS excerpt FROM pages WHERE url LIKE 'http%://_%' GROUP BY 1)"""


@query(
    f"""WITH i AS (SELECT page_id AS id, url, CASE WHEN page_id % 3 = 0 THEN 'own' END AS image, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE '' END AS summary FROM pages WHERE url LIKE 'http%://_%'), {_TOLD_PAGES},
n AS (SELECT url, min(CASE WHEN image IS NULL THEN 0 ELSE 1 END) AS has, min(id) FILTER (image IS NULL) AS bare, min(id) AS any_id FROM i WHERE image IS NULL OR summary = '' GROUP BY 1),
o AS (SELECT url, has, CASE WHEN has = 0 THEN bare ELSE any_id END AS id FROM n),
c1 AS (SELECT o.url, nullif(w.image, '') AS image, nullif(excerpt, '') AS excerpt FROM (SELECT * FROM o ORDER BY has, id LIMIT 40) o LEFT JOIN w USING (url)),
k1 AS (SELECT * FROM c1 WHERE image IS NOT NULL OR excerpt IS NOT NULL),
c2 AS (SELECT o.url, nullif(w.image, '') AS image, nullif(excerpt, '') AS excerpt FROM (SELECT * FROM o WHERE url NOT IN (SELECT url FROM k1) ORDER BY has, id LIMIT 40) o LEFT JOIN w USING (url)),
k AS (SELECT *, 1 AS cycle FROM k1 UNION ALL SELECT *, 2 FROM c2)
SELECT id, coalesce(i.image, k.image) AS image, CASE WHEN summary <> '' THEN summary ELSE coalesce(excerpt, '') END AS summary, cycle FROM i LEFT JOIN k USING (url)"""
)
def enrichment_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as items after two cycles, two hours apart, of at most 40 fetches each: what the first found stays, what it found nothing of is asked again."""
    folder = scratch(spark, "enrichment")
    rows = described(spark, sf_dir).filter("url like 'http%://_%'")
    told = rows.select("page_id", "url", S.page_image(F.col("html"), F.col("url")).alias("image"), S.page_excerpt(F.col("html")).alias("excerpt"))
    told = told.groupBy("url").agg(F.min_by(F.struct("image", "excerpt"), "page_id").alias("t")).select("url", "t.image", "t.excerpt")
    all_items = rows.selectExpr("page_id AS id", "url", "concat('T', page_id) AS title", "if(page_id % 3 = 0, 'own', null) AS image", "if(page_id % 2 = 0, 'text', '') AS summary", f"{NOW} - make_dt_interval(0, 0, 0, cast(page_id AS decimal(18,6))) AS published_at")
    queue = EnrichmentQueue(spark, f"{folder}/cache", budget=40)
    queue.cycle(all_items, told, 1, CLOCK)
    first = queue.cache(CLOCK).select("url", "expires_at")
    done = queue.cycle(all_items, told, 2, CLOCK + dt.timedelta(hours=2))
    now = queue.cache(CLOCK + dt.timedelta(hours=2)).join(first.withColumnRenamed("expires_at", "was"), "url", "left")
    cycle = now.select("url", F.when(F.col("was") == F.col("expires_at"), 1).otherwise(2).alias("cycle"))
    return done.join(cycle, "url", "left").select("id", "image", "summary", "cycle")


@query(
    """WITH d AS (SELECT count(*) AS n FROM documents), r AS (SELECT event_id * 7 % n AS id, value, ts, event_id FROM events, d WHERE NOT (event_id * 7 % n % 3 > 0 AND event_id > 700)),
l AS (SELECT id, id % 10 = 0 AS stays, list({'v': value, 'f': ts, 'l': ts} ORDER BY ts, event_id) AS s FROM r GROUP BY 1),
p AS (SELECT id, stays, list_reduce(s, lambda a, b: CASE WHEN b.l - a.l > INTERVAL 48 HOUR AND NOT stays THEN b WHEN b.v >= a.v THEN {'v': b.v, 'f': a.f, 'l': b.l} ELSE {'v': 0.7 * a.v + 0.3 * b.v, 'f': a.f, 'l': b.l} END) AS s FROM l)
SELECT id, round(s.v, 6) AS score, strftime(s.f, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(s.l, '%Y-%m-%d %H:%M:%S') AS last_seen FROM p WHERE stays OR s.l > (SELECT max(ts) FROM r) - INTERVAL 49 HOUR"""
)
def stream_pool_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of documents with the real keeping time of 48 hours after the lateness of one; items of one source never go."""
    folder = scratch(spark, "pool")
    n = table(spark, sf_dir, "documents").count()
    rows = table(spark, sf_dir, "events").withColumn("id", F.pmod(F.col("event_id") * 7, F.lit(n))).filter("not (id % 3 > 0 and event_id > 700)")
    ticks = rows.select("id", F.col("value").alias("score"), F.lit(None).cast("string").alias("image"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("id") % 10 == 0, "me").otherwise("web").alias("source"), "event_id")
    changes = J.drained(spark, J.rolling_pool(in_batches(ticks, "ts", BATCHES, f"{folder}/in"), exempt=("me",), ties=("event_id",)), "update")
    last = changes.groupBy("id").agg(F.max_by(F.struct("score", "first_seen", "last_seen", "alive"), F.struct("last_seen", ~F.col("alive"))).alias("s"))
    return last.filter("s.alive").select("id", F.round("s.score", 6).alias("score"), _stamp("s.first_seen").alias("first_seen"), _stamp("s.last_seen").alias("last_seen"))


@query(
    """WITH s AS (SELECT day, slot, CAST(day AS TIMESTAMP) + to_hours(h - 9) AS due FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day), (VALUES ('morning', 7), ('lunch', 12), ('evening', 19)) v(slot, h)),
c AS (SELECT day, slot, user_id, count(*) AS n FROM events JOIN s ON ts <= due AND ts > due - INTERVAL 24 HOUR WHERE due <= (SELECT max(ts) FROM events) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY day, slot ORDER BY n DESC, user_id) AS place FROM c)
SELECT CAST(day AS VARCHAR) AS day, slot, place, user_id, n FROM r WHERE place <= 5"""
)
def due_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five busiest readers of the day before each edition, built when the stream's clock passes its hour; each batch comes twice."""
    from pyspark.sql import Window

    folder = scratch(spark, "editions")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts")

    def build(due: DataFrame) -> DataFrame:
        counts = due.groupBy("day", "slot", "user_id").agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("day", "slot").orderBy(F.desc("n"), "user_id"))
        return counts.withColumn("place", place.cast("long")).filter("place <= 5")

    editions = Editions(spark, folder, "event_id long, user_id long, ts timestamp", build)

    def twice(batch: DataFrame, number: int) -> None:
        editions.tick(batch, number)
        editions.tick(batch, number)

    J.run_batches(in_batches(rows, "ts", BATCHES, f"{folder}/in"), "append", twice, f"{folder}/checkpoint")
    return editions.editions().select(F.col("day").cast("string").alias("day"), "slot", "place", "user_id", "n")


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS digest FROM events WHERE value >= 50 AND user_id % 5 > 0)
SELECT user_id, digest, CASE WHEN user_id % 7 = 0 THEN 3 ELSE 1 END AS tries, user_id % 7 > 0 AS delivered FROM d"""
)
def digest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's liked items told to each subscriber once, though every batch comes four times; one address in seven always fails and is given up after three."""
    folder = scratch(spark, "sweep")
    rows = table(spark, sf_dir, "events").filter("value >= 50").selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts")
    subscriptions = rows.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("push/"), (F.col("user_id") % 7).cast("string"))).alias("endpoint"))
    sweep = DigestSweep(spark, f"{folder}/sent", lambda endpoint, body: 500 if endpoint == "push/0" else 201)

    def each(batch: DataFrame, number: int) -> None:
        day = F.to_date(F.col("ts") + F.expr("interval 9 hours")).cast("string")
        digests = batch.groupBy("user_id", day.alias("digest")).agg(F.count("*").alias("count"), F.min("event_id").alias("top_id"), F.lit("title").alias("title"), F.lit(False).alias("adult"))
        for _ in range(4):
            sweep.sweep(digests, subscriptions, number)

    J.run_batches(in_batches(rows, "event_id", BATCHES, f"{folder}/in"), "append", each, f"{folder}/checkpoint")
    sent = sweep.sent().groupBy("user_id", "digest").agg(F.count("*").alias("tries"), F.max(F.col("status") < 300).alias("delivered"))
    return sent.select("user_id", "digest", "tries", "delivered")
