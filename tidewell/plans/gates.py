"""Queries of predicates, gates and joins on items, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import maths as M
from tidewell.functions import text as T
from tidewell.operators import gates as G
from tidewell.plans.base import Catalogue
from tidewell.sources.adapters import NOW, items, registry, signals, table, tagged_items

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: Word lists of the test texts, in the place of those of another language.
TOPIC_WORDS = {"politics": ["tion", "und der"], "religion": ["eau", "ción"]}
BOARDS = [("src3", r"[?&]id=car", "cars"), ("src4", "/1", "religion")]
RUDE = ["thth", "eaueau"]
LOW = ["(?i)^the ", "(?i)^de "]
UNFIT = ["(?i)nd(re|le)", "(^|[^a-z])una(?![a-z])"]

_TOPICS = """list_filter([CASE WHEN source = 'src4' AND id % 3 = 0 AND contains('/b/' || (id % 20), '/1') THEN 'religion' END,
  CASE WHEN contains(title, 'tion') OR contains(title, 'und der') THEN 'politics' END, CASE WHEN contains(title, 'eau') OR contains(title, 'ción') THEN 'religion' END], lambda t: t IS NOT NULL)"""
_TOLD = f"told AS (SELECT *, {_TOPICS} AS topics FROM items)"


def told_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items`` with topics by board and title; a third of them have a url."""
    rows = items(spark, sf_dir).withColumn("url", F.expr("if(id % 3 = 0, concat('https://x.example/b/', id % 20), null)"))
    return rows.withColumn("topics", G.topics_of(F.col("title"), F.col("url"), F.col("source"), BOARDS, TOPIC_WORDS))


@query(f"WITH {_TOLD} SELECT id, array_to_string(list_sort(list_distinct(topics)), ',') AS topics FROM told", "items")
def topic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_items(spark, sf_dir).select("id", F.array_join(F.array_sort("topics"), ",").alias("topics"))


@query(
    f"""WITH {_TOLD}, p AS (SELECT DISTINCT user_id, item_id AS id FROM signals),
f AS (SELECT t.id, t.source, t.topics FROM told t LEFT JOIN registry r USING (source)
  WHERE r.enabled AND NOT r.off_main AND NOT (epoch(TIMESTAMP '2024-01-31 00:00:00' - t.published_at) / 3600.0 >
    CASE WHEN r.max_age_h IS NOT NULL AND (r.max_age_h <= CASE WHEN kind = 'news' THEN 24 ELSE 48 END OR score + comment_count + coverage > 0) THEN r.max_age_h WHEN kind = 'news' THEN 24 ELSE 48 END))
SELECT user_id, id FROM p JOIN f USING (id)
WHERE (user_id + CAST(substring(source, 4) AS INTEGER)) % 7 <> 0 AND NOT (list_contains(topics, 'politics') AND user_id % 2 = 0) AND NOT (list_contains(topics, 'religion') AND user_id % 3 <> 0)""",
    "items", "signals", "registry",
)
def feed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = signals(spark, sf_dir).select("user_id", F.col("item_id").alias("id")).distinct()
    known, users = registry(spark, sf_dir), pairs.select("user_id").distinct()
    muted = users.crossJoin(F.broadcast(known.select("source", "no"))).filter("(user_id + no) % 7 = 0").select("user_id", "source")
    hidden = users.select("user_id", F.expr("explode(array_compact(array(if(user_id % 2 = 0, 'politics', null), if(user_id % 3 != 0, 'religion', null)))) AS topic"))
    return G.feed_gate(pairs, told_items(spark, sf_dir), known, muted, hidden, F.expr(NOW))


@query(
    f"""WITH {_TOLD} SELECT id, NOT (contains(title, 'thth') OR contains(title, 'eaueau') OR regexp_matches(title, '(?i)nd(re|le)') OR regexp_matches(title, '(^|[^a-z])una([^a-z]|$)')
  OR length(trim(title, ' ')) < 3 OR regexp_matches(trim(title, ' '), '(?i)^the ') OR regexp_matches(trim(title, ' '), '(?i)^de ')) AS promotable,
 len(topics) > 0 OR category = 'politics' OR contains(title, 'thth') OR contains(title, 'eaueau') AS ad_unsafe,
 len(topics) > 0 OR CAST(substring(source, 4) AS INTEGER) % 11 = 5 AS left_out FROM told WHERE title IS NOT NULL AND source IS NOT NULL""",
    "items",
)
def promotion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = registry(spark, sf_dir).select("source", F.col("adult").alias("adult_source"))
    rows = told_items(spark, sf_dir).filter("title is not null and source is not null").join(known, "source", "left")
    title, topics, category = F.col("title"), F.col("topics"), F.col("category")
    return rows.select(
        "id",
        G.promotable(title, RUDE, UNFIT, LOW).alias("promotable"),
        G.ad_unsafe(topics, category, title, RUDE).alias("ad_unsafe"),
        G.left_out_of_reports(topics, category, F.lit(False), F.col("adult_source")).alias("left_out"),
    )


@query("SELECT id, coalesce(epoch(TIMESTAMP '2024-01-31 00:00:00' - CASE WHEN id % 5 > 0 THEN published_at END) / 3600.0 <= 12, true) AS inside FROM items", "items")
def window_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", G.in_window(F.expr("if(id % 5 > 0, published_at, null)"), F.expr(NOW), 12).alias("inside"))


_IMAGES = ["//cdn.example/a.jpg", "http://pics.example/banner/b.png", "https://img.youtube.com/vi/abcdefghijk/hq.jpg", "https://img.youtube.com/vi/clip/link/hq.jpg", "rel/a.png", "http://x.example/noimage.GIF", "ftp://x.example/a.png", " http://y.example/ok.webp "]
_IMG = "[" + ", ".join(f"'{u}'" for u in _IMAGES) + "]"


@query(
    f"""WITH p AS (SELECT page_id, url, trim(({_IMG})[page_id % 8 + 1], ' ') AS raw, page_id % 3 > 0 AS ok FROM pages),
i AS (SELECT *, CASE WHEN starts_with(raw, '//') THEN 'https:' || raw ELSE raw END AS whole FROM p),
n AS (SELECT *, CASE WHEN regexp_matches(whole, '(?i)^https?://') THEN CASE WHEN starts_with(whole, 'http://') AND ok THEN 'https://' || substring(whole, 8) ELSE whole END END AS image FROM i)
SELECT page_id, CASE WHEN starts_with(url, 'http://') AND ok THEN 'https://' || substring(url, 8) ELSE url END AS url, image,
  coalesce(contains(image, '/banner/') OR ends_with(lower(image), '/noimage.gif') OR contains(image, '/vi/clip/'), false) AS junk FROM n"""
)
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"element_at(array({_IMG[1:-1]}), int(page_id % 8 + 1)) AS raw"), (F.col("page_id") % 3 > 0).alias("ok"))
    rows = rows.withColumn("image", G.image_url(F.col("raw"), F.col("ok")))
    return rows.select("page_id", G.https_url(F.col("url"), F.col("ok")).alias("url"), "image", F.coalesce(G.junk_image(F.col("image")), F.lit(False)).alias("junk"))


@query(
    """WITH h AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN '127.0.0.' || (page_id % 256) WHEN 1 THEN '10.1.2.3' WHEN 2 THEN '172.' || (page_id % 40) || '.0.1' WHEN 3 THEN 'a.localhost' WHEN 4 THEN '[fd00::1]'
  WHEN 5 THEN '192.168.1.1:8080' WHEN 6 THEN 'user@printer.local' WHEN 7 THEN '169.254.169.254' ELSE regexp_extract(url, '://([^/?#]*)', 1) END AS host, page_id % 9 AS k, page_id % 40 AS b FROM pages)
SELECT page_id, CASE WHEN k = 8 THEN host <> '' AND page_id % 4 > 0 WHEN k = 2 THEN NOT (b BETWEEN 16 AND 31) AND page_id % 4 > 0 ELSE false END AS safe FROM h"""
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = """CASE page_id % 9 WHEN 0 THEN concat('127.0.0.', page_id % 256) WHEN 1 THEN '10.1.2.3' WHEN 2 THEN concat('172.', page_id % 40, '.0.1') WHEN 3 THEN 'a.localhost' WHEN 4 THEN '[fd00::1]'
      WHEN 5 THEN '192.168.1.1:8080' WHEN 6 THEN 'user@printer.local' WHEN 7 THEN '169.254.169.254' ELSE regexp_extract(url, '://([^/?#]*)', 1) END"""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(f"concat(if(page_id % 4 > 0, 'https://', 'ftp://'), {host}, '/x') AS u"))
    return rows.select("page_id", G.safe_url(F.col("u")).alias("safe"))


@query("SELECT id, lang <> 'en' OR id % 5 = 0 AS overseas, id % 5 = 0 OR id % 7 = 0 AS alien FROM items WHERE lang IS NOT NULL", "items")
def foreign_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test texts' home language is English, so it stands for the home language here."""
    home = F.when(F.col("lang") == "en", "ko").otherwise(F.col("lang"))
    translated, needs, none = F.col("id") % 5 == 0, F.col("id") % 7 == 0, F.lit(None).cast("string")
    return items(spark, sf_dir).filter("lang is not null").select("id", G.overseas(home, none, translated).alias("overseas"), G.foreign(none, translated, needs).alias("alien"))


_DEALS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '[' || p_brand || '] ' || p_name || ' (' || (p_size * 1000) || '원/무배)' WHEN 1 THEN p_name || ' $' || p_size WHEN 2 THEN '[news] ' || p_name ELSE p_name || ' (' || p_size || ')' END AS title, p_name, p_brand, p_size FROM part"


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = "CASE p_partkey % 4 WHEN 0 THEN concat('[', p_brand, '] ', p_name, ' (', p_size * 1000, '원/무배)') WHEN 1 THEN concat(p_name, ' $', p_size) WHEN 2 THEN concat('[news] ', p_name) ELSE concat(p_name, ' (', p_size, ')') END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{title} AS title", "p_name")


@query(
    f"""WITH d AS ({_DEALS})
SELECT id, id % 4 IN (0, 1) AS deal, CASE id % 4 WHEN 0 THEN p_brand WHEN 2 THEN 'news' END AS mall, CASE id % 4 WHEN 1 THEN p_name || ' $' || p_size WHEN 3 THEN title ELSE p_name END AS name,
  CASE WHEN id % 4 = 0 THEN (p_size * 1000) || '원/무배' END AS price FROM d"""
)
def deal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deals(spark, sf_dir).withColumn("d", T.deal_parts(F.col("title")))
    return rows.select("id", T.is_deal(F.lit(None).cast("boolean"), F.col("title")).alias("deal"), "d.mall", "d.name", "d.price")


#: Where products of the test tables lead; the lists are data and are given by the caller.
TAG_PLACES = {"alpha": "home", "and": "oversea", "tion": "book"}
PLACE_RULES = [("metal", "steel|nickel|tin|copper|brass"), ("paint", "blue|red|green"), ("oversea", "[$€£¥]")]


@query(
    f"""WITH d AS ({_DEALS}), m AS (SELECT id, lower(title) AS t, CASE WHEN id % 6 = 0 THEN 'home' WHEN id % 10 = 0 THEN 'book' END AS by_tag FROM d)
SELECT id, coalesce(by_tag, CASE WHEN regexp_matches(t, 'steel|nickel|tin|copper|brass') THEN 'metal' WHEN regexp_matches(t, 'blue|red|green') THEN 'paint' WHEN contains(t, '$') THEN 'oversea' END) AS dest FROM m"""
)
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.expr("array_compact(array('none', if(id % 6 = 0, 'Alpha', null), if(id % 10 = 0, 'tion', null)))")
    return _deals(spark, sf_dir).select("id", T.destination(tags, F.col("title"), TAG_PLACES, PLACE_RULES).alias("dest"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_FIRST, _SECOND = ["brave", "calm", "quick", "shy", "loud"], ["otter", "panda", "fox", "whale", "owl", "crane", "moose"]


@query(
    f"""WITH b AS (SELECT page_id, coalesce(url, '') || '|src' || (page_id % 7) || '|t|' AS basis FROM pages), h AS (SELECT page_id, {_FNV.format('basis')} AS h, {_FNV.format("CAST(page_id AS VARCHAR) || ':0'")} AS n FROM b)
SELECT page_id, 'it_' || lower(to_base(h, 36)) AS id, ['brave', 'calm', 'quick', 'shy', 'loud'][n % 5 + 1] || ' ' || ['otter', 'panda', 'fox', 'whale', 'owl', 'crane', 'moose'][n // 5 % 7 + 1] || ' ' || (n % 89 + 10) AS nick,
  CASE WHEN {_FNV.format("CAST(page_id AS VARCHAR)")} % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM h"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by content, nicknames and the side of a comparison, all by hash."""
    basis = F.concat(F.coalesce("url", F.lit("")), F.lit("|src"), (F.col("page_id") % 7).cast("string"), F.lit("|t|"))
    variant = F.when(M.fnv1a(F.col("page_id").cast("string")) % 2 == 0, "A").otherwise("B")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("it_"), M.base36(M.fnv1a(basis))).alias("id"), T.nickname(F.col("page_id"), _FIRST, _SECOND).alias("nick"), variant.alias("variant"))


@query("SELECT c_custkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS h FROM (SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM customer)")
def signed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", M.signed31(F.col("c_name")).alias("h"))


_WORK = "SELECT o_orderkey AS id, ['review', 'Pay the invoice', 'update payload', 'plan', 'DELETE old rows'][o_orderkey % 5 + 1] AS title, CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'open' END AS status, lower(split_part(o_orderpriority, '-', 2)) AS risk, CASE WHEN o_custkey % 3 > 0 THEN 'team' || (o_custkey % 3) END AS target, o_custkey % 10 = 0 AS needs FROM orders"


@query(
    f"""WITH w AS ({_WORK}), n AS (SELECT *, needs OR risk IN ('high', 'critical') OR regexp_matches(lower(title), 'publish|delete|pay|buy') AS ask FROM w)
SELECT id, CASE WHEN ask THEN 'decision_queue' WHEN status IS NULL OR status <> 'ready' THEN 'backlog' ELSE coalesce(nullif(target, ''), 'general') || '_dispatch' END AS next_queue,
  CASE WHEN ask THEN 'human_approval_required' WHEN status IS NULL OR status <> 'ready' THEN 'not_ready' ELSE 'ready_for_dispatch' END AS reason FROM n"""
)
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "element_at(array('review', 'Pay the invoice', 'update payload', 'plan', 'DELETE old rows'), int(o_orderkey % 5 + 1)) AS title",
        "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'open' END AS status", "lower(split_part(o_orderpriority, '-', 2)) AS risk",
        "if(o_custkey % 3 > 0, concat('team', o_custkey % 3), null) AS target", "o_custkey % 10 = 0 AS requires_approval",
    )
    return G.routed(rows).select("id", "next_queue", "reason")


@query(
    """WITH p AS (SELECT conv_id, turn, substring(split_part(text, chr(10), 1), 1, 150) AS title, text AS body, turn % 12 AS tags, turn AS recent FROM conversations),
t AS (SELECT *, length(trim(title, ' ')) AS n FROM p)
SELECT conv_id, turn, concat_ws(',', CASE WHEN n < 2 THEN 'title short' END, CASE WHEN n > 120 THEN 'title long' END, CASE WHEN length(body) > 2000 THEN 'body long' END, CASE WHEN tags > 8 THEN 'tags' END,
  CASE WHEN contains(title || ' ' || body, 'eaueau') OR contains(title || ' ' || body, 'thth') THEN 'banned' END, CASE WHEN recent >= 5 THEN 'rate' END) AS errors FROM t"""
)
def post_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "substring(split_part(text, '\n', 1), 1, 150) AS title", "text AS body", "array_repeat('t', int(turn % 12)) AS tags")
    return rows.select("conv_id", "turn", F.array_join(G.post_errors(F.col("title"), F.col("body"), F.col("tags"), F.col("turn"), RUDE), ",").alias("errors"))


@query(
    """WITH p AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' 17' WHEN 1 THEN ' <b>' WHEN 2 THEN ' 추천 300' ELSE '' END AS t, 'of 17 and 300' AS source FROM conversations)
SELECT conv_id, turn, length(trim(t, ' ')) BETWEEN 40 AND 700 AND turn % 4 IN (0, 3) AND len(list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: x NOT IN ('17', '300'))) = 0 AS sound FROM p"""
)
def sound_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "concat(text, CASE turn % 4 WHEN 0 THEN ' 17' WHEN 1 THEN ' <b>' WHEN 2 THEN ' 추천 300' ELSE '' END)"
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{told} AS t")
    return rows.select("conv_id", "turn", G.sound_paragraph(F.col("t"), F.lit("of 17 and 300")).alias("sound"))


_COPY = ["' 써 보니'", "' 100% 만족'", "' 후기 4.5점'", "' 판매 1위'", "' 30명이 구매'", "' 오늘만'", "'％'", "' 보장해요'"]
_SUFFIX = "CASE {0} % 11 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_COPY)) + " ELSE '' END"


@query(
    f"""WITH t AS (SELECT event_id, substring('a word of copy that runs on', 1, 2 + CAST(event_id % 26 AS INTEGER)) || {_SUFFIX.format('event_id')} AS hook, repeat('line ', CAST(event_id % 12 AS INTEGER)) AS line, CASE WHEN event_id % 13 = 0 THEN '<b>' ELSE 'go on' END AS cta FROM events)
SELECT event_id, length(trim(hook, ' ')) BETWEEN 6 AND 30 AND event_id % 11 NOT IN (0, 1, 2, 3, 4, 5, 6) AND length(trim(line, ' ')) BETWEEN 10 AND 46 AND event_id % 13 > 0 AS sound, event_id % 11 IN (1, 2, 3, 4, 7) AS claims FROM t"""
)
def sound_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of advert copy with all kinds of claims, and whether they may stand."""
    hook = f"concat(substring('a word of copy that runs on', 1, 2 + int(event_id % 26)), {_SUFFIX.format('event_id')})"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{hook} AS hook", "repeat('line ', int(event_id % 12)) AS line", "if(event_id % 13 = 0, '<b>', 'go on') AS cta")
    return rows.select("event_id", G.sound_card(F.col("hook"), F.col("line"), F.col("cta")).alias("sound"), G.banned_claim(F.col("hook")).alias("claims"))


# --- joins ---


@query(
    "SELECT p.user_id, p.item_id AS id FROM (SELECT DISTINCT user_id, item_id FROM signals) p WHERE NOT EXISTS (SELECT 1 FROM signals s WHERE s.user_id = p.user_id AND s.item_id = p.item_id AND s.signal < 0)",
    "signals",
)
def unseen_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = signals(spark, sf_dir)
    return G.unseen(rated.select("user_id", "item_id").distinct(), rated.filter("signal < 0").select("user_id", "item_id")).select("user_id", F.col("item_id").alias("id"))


@query(
    """WITH old AS (SELECT id, score, 'img' || id AS image, TIMESTAMP '2024-01-01 00:00:00' AS first_seen FROM items WHERE id % 3 > 0), new AS (SELECT id, score + 1 AS score, CASE WHEN id % 4 = 0 THEN 'fresh' || id END AS image FROM items WHERE id % 5 > 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.score, o.score) AS score, coalesce(n.image, o.image) AS image, coalesce(o.first_seen, TIMESTAMP '2024-01-31 00:00:00') = TIMESTAMP '2024-01-01 00:00:00' AS old FROM old o FULL JOIN new n ON o.id = n.id""",
    "items",
)
def pool_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    old = rows.filter("id % 3 > 0").selectExpr("id", "score", "concat('img', id) AS image", "timestamp '2024-01-01 00:00:00' AS first_seen")
    new = rows.filter("id % 5 > 0").selectExpr("id", "score + 1 AS score", "if(id % 4 = 0, concat('fresh', id), null) AS image", f"{NOW} AS first_seen")
    return G.upsert_pool(old, new).selectExpr("id", "score", "image", "first_seen = timestamp '2024-01-01 00:00:00' AS old")


@query("SELECT i.category, count(*) AS likes FROM signals s JOIN items i ON i.id = s.item_id WHERE s.signal > 0 AND i.source IN ('src2', 'src3', 'src5') GROUP BY 1", "signals", "items")
def liked_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes that the posts of three sources received, by category."""
    mine = items(spark, sf_dir).filter("source in ('src2', 'src3', 'src5')").select(F.col("id").alias("item_id"), "category")
    return signals(spark, sf_dir).filter("signal > 0").join(mine, "item_id").groupBy("category").agg(F.count("*").alias("likes"))


_VISITS = "SELECT event_id AS visit, 's' || (user_id % 40) AS session, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END AS device, 'v' || (user_id % 50) AS visitor, CASE WHEN user_id % 5 < 3 THEN 'u' || (user_id % 60) WHEN user_id % 5 = 3 THEN 'bad id!' END AS claimed FROM events"


@query(
    f"""WITH v AS ({_VISITS}), u AS (SELECT DISTINCT 'u' || user_id AS user_id FROM events WHERE user_id % 7 < 4), s AS (SELECT DISTINCT 's' || (user_id % 40) AS session, 'u' || (user_id % 40) AS user_id FROM events WHERE user_id % 40 < 12),
d AS (SELECT 'v' || n AS visitor, 'u' || (n * 2) AS user_id FROM range(0, 50, 4) t(n)), j AS (
SELECT v.visit, v.claimed, su.user_id AS a, du.user_id AS b, d.user_id AS c, cu.user_id AS e FROM v LEFT JOIN s ON s.session = v.session LEFT JOIN u su ON su.user_id = s.user_id LEFT JOIN u du ON du.user_id = v.device
 LEFT JOIN d ON d.visitor = v.visitor LEFT JOIN u cu ON cu.user_id = v.claimed)
SELECT visit, coalesce(a, b, c, e, CASE WHEN regexp_full_match(claimed, '[A-Za-z0-9_-]{{1,64}}') THEN claimed END) AS who,
 CASE WHEN a IS NOT NULL THEN 'login' WHEN b IS NOT NULL THEN 'cookie' WHEN c IS NOT NULL THEN 'visitor' WHEN e IS NOT NULL THEN 'storage' ELSE 'new' END AS how FROM j"""
)
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    visits = events.selectExpr(
        "event_id AS visit", "concat('s', user_id % 40) AS session", "if(user_id % 3 = 0, concat('u', user_id), null) AS device", "concat('v', user_id % 50) AS visitor",
        "CASE WHEN user_id % 5 < 3 THEN concat('u', user_id % 60) WHEN user_id % 5 = 3 THEN 'bad id!' END AS claimed",
    )
    users = events.filter("user_id % 7 < 4").selectExpr("concat('u', user_id) AS user_id").distinct()
    sessions = events.filter("user_id % 40 < 12").selectExpr("concat('s', user_id % 40) AS session", "concat('u', user_id % 40) AS user_id").distinct()
    devices = spark.range(0, 50, 4).selectExpr("concat('v', id) AS visitor", "concat('u', id * 2) AS user_id")
    return G.identities(visits, sessions, users, devices).select("visit", "who", "how")


_TERMS = [("thterti", 800, ["the ertion of reti", "x"]), ("une", 500, ["eaueu réla ention"]), ("la", 2000, []), ("die", 300, ["und der aulich nicht"]), ("tion", 900, ["and edst threeain for"])]


@query(
    r"""WITH t(term, traffic) AS (VALUES ('thterti', 800), ('une', 500), ('la', 2000), ('die', 300), ('tion', 900)),
n(term, no, news) AS (VALUES ('thterti', 0, 'the ertion of reti'), ('thterti', 1, 'x'), ('une', 0, 'eaueu réla ention'), ('die', 0, 'und der aulich nicht'), ('tion', 0, 'and edst threeain for')),
h AS (SELECT id, concat_ws(' ', coalesce(title, ''), coalesce(summary, '')) AS hay, lower(coalesce(title, '')) AS title FROM items),
m AS (SELECT id, term, CAST(traffic AS DOUBLE) AS value, 'term' AS how FROM h JOIN t ON regexp_matches(hay, '(?i)(^|[^a-zA-Z0-9])' || term || '($|[^a-zA-Z0-9])')),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(title, '[^가-힣a-z0-9]+'), lambda x: length(x) >= 3)) AS w FROM h),
nw AS (SELECT DISTINCT term, no, w FROM (SELECT term, no, unnest(regexp_split_to_array(news, '[^가-힣a-z0-9]+')) AS w FROM n) WHERE length(w) >= 3),
s AS (SELECT DISTINCT id, term FROM (SELECT w.id, nw.term, nw.no, count(*) AS c FROM w JOIN nw USING (w) GROUP BY ALL) WHERE c >= 2),
al AS (SELECT * FROM m UNION ALL SELECT id, term, traffic * 0.6, 'news' FROM s JOIN t USING (term) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = s.id AND m.term = s.term))
SELECT id, term, value, how FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, term DESC) AS r FROM al) WHERE r = 1""",
    "items",
)
def interest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.interest_matches(items(spark, sf_dir), spark.createDataFrame(_TERMS, "term string, traffic int, news array<string>"))


@query(
    """WITH t(name) AS (VALUES ('#Tion'), ('a'), ('und'), ('eaux'), ('#zzzz')) SELECT name, (SELECT count(*) FROM items WHERE length(replace(name, '#', '')) >= 2 AND contains(lower(title), lower(replace(name, '#', '')))) AS hits FROM t""",
    "items",
)
def trend_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = spark.createDataFrame([("#Tion",), ("a",), ("und",), ("eaux",), ("#zzzz",)], "name string")
    return G.trend_hits(trends, items(spark, sf_dir).select("title"))


@query("SELECT CAST(day AS VARCHAR) AS day, CAST(lag(day) OVER (ORDER BY day) AS VARCHAR) AS before, CAST(lead(day) OVER (ORDER BY day) AS VARCHAR) AS after FROM (SELECT DISTINCT day FROM track WHERE event_id % 3 = 0)", "track")
def archive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.sources.adapters import track_events

    days = G.archive_neighbours(track_events(spark, sf_dir).filter("event_id % 3 = 0").select("day"))
    return days.select(*[F.col(c).cast("string").alias(c) for c in ("day", "before", "after")])


@query(
    """WITH t AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CASE WHEN hour(ts + INTERVAL 9 HOUR) >= 19 THEN 'evening' WHEN hour(ts + INTERVAL 9 HOUR) >= 12 THEN 'lunch' WHEN hour(ts + INTERVAL 9 HOUR) >= 7 THEN 'morning' END AS slot, event_type FROM events),
d AS (SELECT DISTINCT day FROM t), e AS (SELECT day, slot, day || '/' || slot || '/' || count(*) AS edition FROM t WHERE event_type = 'signup' AND slot IN ('morning', 'lunch') AND day(day) % 4 > 1 GROUP BY day, slot)
SELECT CAST(d.day AS VARCHAR) AS day, s AS slot, coalesce(a.edition, b.edition, 'live') AS edition FROM d CROSS JOIN (VALUES ('morning'), ('lunch'), ('evening')) t(s) LEFT JOIN e a ON a.day = d.day AND a.slot = s LEFT JOIN e b ON b.day = d.day - 1 AND b.slot = s"""
)
def edition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions that hold the signups of a slot, kept on some days alone, asked for on every day that has events."""
    from tidewell.functions.dates import due_slot, kst_day

    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows = rows.select(kst_day(F.col("ts")).alias("day"), due_slot(F.hour(F.col("ts") + F.expr("interval 9 hours"))).alias("slot"), "event_type")
    asked = rows.select("day").distinct().select("day", F.explode(F.array(*map(F.lit, ("morning", "lunch", "evening")))).alias("slot"))
    held = rows.filter("event_type = 'signup' and slot in ('morning', 'lunch') and day(day) % 4 > 1").groupBy("day", "slot").agg(F.count("*").alias("n"))
    kept = held.select("day", "slot", F.concat_ws("/", F.col("day").cast("string"), "slot", F.col("n").cast("string")).alias("edition"))
    return G.edition_for(asked, kept).withColumn("day", F.col("day").cast("string"))


@query(
    """WITH a AS (SELECT id FROM items WHERE id % 2 = 0), b AS (SELECT id FROM items WHERE id % 3 = 0)
SELECT 'union' AS op, count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'bag', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM a UNION ALL SELECT id FROM b)
UNION ALL SELECT 'except', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'intersect', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)""",
    "items",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = items(spark, sf_dir).select("id")
    a, b = ids.filter("id % 2 = 0"), ids.filter("id % 3 = 0")
    sets = {"union": a.union(b).distinct(), "bag": a.unionByName(b), "except": a.subtract(b), "intersect": a.intersect(b)}
    whole = None
    for name, rows in sets.items():
        one = rows.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("id").alias("s"))
        whole = one if whole is None else whole.union(one)
    return whole


@query(
    "SELECT a.id AS a, b.id AS b, len(list_intersect(a.tags, b.tags)) AS shared FROM tagged a JOIN tagged b ON b.id = a.id + 1 WHERE len(list_intersect(a.tags, b.tags)) > 0", "tagged"
)
def shared_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that neighbouring items share."""
    rows = tagged_items(spark, sf_dir).select("id", "tags")
    met = rows.select(F.col("id").alias("a"), F.col("tags").alias("s")).join(rows.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("tags").alias("t")), "a")
    return met.select("a", "b", F.size(F.array_intersect("s", "t")).cast("long").alias("shared")).filter("shared > 0")


@query(
    """WITH r AS (SELECT user_id, item_id AS id, arg_max(signal, event_id) AS mine FROM signals GROUP BY 1, 2), c AS (SELECT conv_id AS id, count(*) AS comments FROM conversations GROUP BY 1)
SELECT r.user_id, i.id, 'user_' || lower(to_hex(i.id % 4096)) AS author, mine, coalesce(comments, 0) AS comments, (r.user_id + i.id) % 6 = 0 AS saved FROM r JOIN items i USING (id) LEFT JOIN c USING (id)""",
    "signals",
    "items",
)
def public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a reader sees them: own rating, whether saved, comments, and the author behind a mask."""
    mine = signals(spark, sf_dir).groupBy("user_id", F.col("item_id").alias("id")).agg(F.max_by("signal", "event_id").alias("mine"))
    comments = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("comments"))
    saved = mine.filter("(user_id + id) % 6 = 0").select("user_id", "id", F.lit(True).alias("saved"))
    rows = mine.join(items(spark, sf_dir).select("id"), "id").join(comments, "id", "left").join(saved, ["user_id", "id"], "left")
    author = F.concat(F.lit("user_"), F.lower(F.hex(F.col("id") % 4096)))
    return rows.select("user_id", "id", author.alias("author"), "mine", F.coalesce("comments", F.lit(0)).alias("comments"), F.coalesce("saved", F.lit(False)).alias("saved"))


@query(
    r"""WITH r AS (SELECT doc_id AS id, source, ['tech', 'weird', NULL, 'life'][doc_id % 4 + 1] AS category, ['community', 'Community', NULL][doc_id % 3 + 1] AS kind, ['rss', 'me', NULL, 'api', 'seed'][doc_id % 5 + 1] AS via,
  split_part(text, chr(10), 1) AS title, text, CASE WHEN doc_id % 7 > 0 THEN doc_id % 50 END AS score, doc_id % 3 AS views, CASE WHEN doc_id % 6 = 0 THEN 77 END AS len FROM documents)
SELECT id, coalesce(source, 'unknown') AS source, CASE WHEN category IN ('tech', 'life') THEN category ELSE 'news' END AS category, CASE WHEN kind = 'community' THEN kind ELSE 'news' END AS kind, coalesce(via, 'seed') AS via,
  substring(coalesce(title, ''), 1, 300) AS title, substring(coalesce(text, ''), 1, CASE WHEN via IS NULL OR via IN ('me', 'seed') THEN 1000 ELSE 200 END) AS summary,
  CASE WHEN id % 2 = 0 THEN 'https://' ELSE 'http://' END || 'x.example/' || id AS url, 'https://cdn/' || id AS image, coalesce(score, 0) AS score, CASE WHEN views > 0 THEN views END AS view_count,
  coalesce(len, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+'))) AS length FROM r"""
)
def normalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "source", "element_at(array('tech', 'weird', null, 'life'), int(doc_id % 4 + 1)) AS category", "element_at(array('community', 'Community', null), int(doc_id % 3 + 1)) AS kind",
        "element_at(array('rss', 'me', null, 'api', 'seed'), int(doc_id % 5 + 1)) AS via", "split_part(text, '\n', 1) AS title", "text AS summary", "concat('http://x.example/', doc_id) AS url",
        "concat('//cdn/', doc_id) AS image", "doc_id % 2 = 0 AS https_ok", "if(doc_id % 7 > 0, doc_id % 50, null) AS score", "0 AS comment_count", "doc_id % 3 AS view_count", "0 AS coverage",
        "if(doc_id % 6 = 0, 77, null) AS length", f"{NOW} AS published_at",
    )
    return G.normalized(raw, ["tech", "life"]).drop("comment_count", "coverage", "published_at")
