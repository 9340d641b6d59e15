"""Queries of taste, similar readers and learning, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import hot
from tidewell.operators import taste as U
from tidewell.plans.base import Catalogue
from tidewell.plans.ranking import _HOT
from tidewell.sources.adapters import NOW, items, met_items, preferences, registry, signals, table, tagged_items

CATALOGUE = Catalogue()
query = CATALOGUE.query

_PAIRS = "pairs AS MATERIALIZED (SELECT DISTINCT user_id, item_id AS id FROM signals)"
_TASTE = f"""{_PAIRS},
sums AS MATERIALIZED (SELECT p.user_id, p.id, sum(coef * weight) AS t, sum(CASE f.ns WHEN 'tag' THEN coef / 1.3 WHEN 'category' THEN 1 ELSE 0 END * abs(weight)) AS known
  FROM pairs p JOIN feats f ON f.id = p.id JOIN prefs q ON q.user_id = p.user_id AND q.ns = f.ns AND q.key = f.key GROUP BY ALL),
taste AS (SELECT p.user_id, p.id, coalesce(t, 0) + coalesce(l.weight, 0) * CASE WHEN words >= 400 THEN 1 WHEN words <= 120 THEN -1 ELSE 0 END * 0.4 AS taste,
    round(coalesce(known, 0), 9) AS known, i.score, i.comment_count, i.coverage, i.source, i.category, i.kind, i.ord,
    epoch(TIMESTAMP '2024-01-31 00:00:00' - i.published_at) / 3600.0 AS age
  FROM pairs p JOIN tagged i ON i.id = p.id LEFT JOIN sums s ON s.user_id = p.user_id AND s.id = p.id
  LEFT JOIN prefs l ON l.user_id = p.user_id AND l.ns = 'style')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("user_id", F.col("item_id").alias("id")).distinct()


@query(f"WITH {_TASTE} SELECT user_id, id, round(taste, 9) + 0.0 AS taste, round(known, 9) AS known FROM taste", "prefs")
def taste_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.taste_scores(_pairs(spark, sf_dir), tagged_items(spark, sf_dir), preferences(spark, sf_dir))
    return rows.select("user_id", "id", F.round("taste", 9).alias("taste"), F.round("known", 9).alias("known"))


_HASH = "list_reduce(list_prepend(CAST(1 AS BIGINT), list_transform(string_split(CAST(id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295)"
_SCORES = f"""{_TASTE},
hashed AS (SELECT *, {_HASH} AS hash FROM taste),
scored AS (SELECT user_id, id, source, taste + 0.5 * log10(1 + score + comment_count * 1.5) / 3 + 0.6 * exp(-age / 72)
    + CASE WHEN (score + comment_count + coverage >= 1 OR age <= 12) AND known < 0.4 AND hash % 4 = 0 THEN 0.2 ELSE 0 END
    + (hash % 1000 / 1000.0 - 0.5) * 0.2 - CASE WHEN id % 5 = 0 THEN 3 ELSE 0 END AS score FROM hashed)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return U.item_scores(pairs, tagged_items(spark, sf_dir), preferences(spark, sf_dir), F.expr(NOW), seen=pairs.filter("id % 5 = 0"))


@query(f"WITH {_SCORES} SELECT user_id, id, round(score, 6) AS score FROM scored", "prefs")
def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("user_id", "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_SCORES}, r AS (SELECT user_id, id, round(score, 6) AS score FROM scored),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM r)
SELECT user_id, id, score, rank FROM n WHERE rank <= 10""",
    "prefs",
)
def rank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("user_id", "id", F.round("score", 6).alias("score"))
    return U.ranked(rows, "user_id", "score", 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"{_HOT}, {_TASTE} SELECT t.user_id, t.id, round(h.hot + 0.4 * tanh(t.taste / 2), 5) AS score FROM taste t JOIN hot h ON h.id = t.id", "items", "prefs"
)
def global_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tagged_items(spark, sf_dir)
    rows = U.taste_scores(_pairs(spark, sf_dir), known, preferences(spark, sf_dir))
    heat = hot.hot_scores(items(spark, sf_dir), F.expr(NOW)).select("id", "hot")
    score = U.global_score(F.col("hot"), F.col("taste"), F.lit(None).cast("double"))
    return rows.join(heat, "id").select("user_id", "id", F.round(score, 5).alias("score"))


@query("SELECT user_id, key, CASE WHEN weight >= 0.5 THEN 'picked' ELSE 'hated' END AS stance FROM prefs WHERE ns = 'category' AND (weight >= 0.5 OR weight <= -1)", "prefs")
def category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.category_sets(preferences(spark, sf_dir))


@query(
    """SELECT id, CAST(CASE WHEN lean IS NULL THEN 1 ELSE greatest(0.2, least(1.8, 1 + 0.6 * lean / 2)) END AS DOUBLE) AS lean,
 CAST(CASE WHEN kind = 'news' THEN greatest(0.2, least(1.8, 1 - 0.8 * 0.75)) ELSE greatest(0.2, least(1.8, 1 + 0.8 * 0.75)) END AS DOUBLE) AS mix
FROM items LEFT JOIN registry USING (source)""",
    "items",
    "registry",
)
def lean_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).join(registry(spark, sf_dir).select("source", "lean"), "source", "left")
    lean, mix = U.lean_multiplier(F.col("lean"), F.lit(0.6)), U.mix_multiplier(F.col("kind"), F.lit(-0.75))
    return rows.select("id", F.round(lean, 6).alias("lean"), F.round(mix, 6).alias("mix"))


@query(
    """WITH l AS (SELECT user_id, ns AS list, key, weight, -weight AS o FROM prefs WHERE weight > 0 AND ns IN ('category', 'tag', 'source')
  UNION ALL SELECT user_id, 'disliked', key, weight, weight FROM prefs WHERE weight < -0.3 AND ns IN ('category', 'tag')),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, list ORDER BY o, key) AS place FROM l)
SELECT user_id, list, place, key, floor(weight * 100 + 0.5) / 100 AS weight FROM r WHERE place <= 6""",
    "prefs",
)
def top_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.top_preferences(preferences(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH {_PAIRS},
own AS (SELECT p.user_id, p.id, f.ns AS kind, f.key, weight * CASE f.ns WHEN 'tag' THEN 1.3 WHEN 'source' THEN 0.9 ELSE 1 END AS weight
  FROM pairs p JOIN feats f ON f.id = p.id JOIN prefs q ON q.user_id = p.user_id AND q.ns = f.ns AND q.key = f.key WHERE weight > 0.2),
al AS (SELECT * FROM own UNION ALL SELECT user_id, id, 'popular', 'popular', 0.5 FROM pairs JOIN items USING (id) WHERE log10(1 + score + comment_count * 1.5) / 3 > 0.6
  UNION ALL SELECT user_id, id, 'fresh', 'fresh', 0.4 FROM pairs JOIN items USING (id) WHERE exp(-(epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0) / 72) > 0.6),
full_ AS (SELECT * FROM al UNION ALL SELECT user_id, id, 'explore', 'explore', 0.1 FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.user_id = p.user_id AND al.id = p.id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY round(weight, 6) DESC, kind, key) AS place FROM full_)
SELECT user_id, id, place, kind, key, CAST(round(weight, 6) AS DOUBLE) AS weight FROM r WHERE place <= 3""",
    "items",
    "prefs",
)
def explain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.reasons(_pairs(spark, sf_dir), tagged_items(spark, sf_dir), preferences(spark, sf_dir).withColumn("weight", F.round("weight", 6)), F.expr(NOW))
    return rows.select("user_id", "id", F.col("place").cast("long").alias("place"), "kind", "key", F.round("weight", 6).alias("weight"))


@query(
    """WITH w AS (SELECT user_id, count(*) FILTER (abs(weight) >= 0.5) AS telling, stddev_pop(weight) AS sd FROM prefs WHERE ns IN ('category', 'tag') GROUP BY 1),
f AS (SELECT user_id, count(*) // 8 AS n FROM signals GROUP BY 1),
l AS (SELECT user_id, floor((0.35 * least(1, telling / 8) + 0.25 * least(1, sd / 2) + 0.4 * least(1, coalesce(n, 0) / 20)) * 100 + 0.5) / 100 AS level FROM w LEFT JOIN f USING (user_id))
SELECT user_id, level, CASE WHEN level < 0.25 THEN 'survey' WHEN level < 0.6 THEN 'calibrating' ELSE 'personalized' END AS phase FROM l""",
    "signals",
    "prefs",
)
def specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = signals(spark, sf_dir).groupBy("user_id").agg(F.expr("count(*) div 8").alias("n"))
    return U.specialization(preferences(spark, sf_dir), feedback)


_SIMS = """n AS (SELECT user_id, sqrt(sum(weight * weight)) AS norm FROM prefs WHERE ns <> 'style' GROUP BY 1 HAVING count(*) FILTER (ns = 'category') > 0 AND sum(weight * weight) > 0),
sims AS (SELECT a.user_id AS a, b.user_id AS b, round(sum(a.weight * b.weight) / any_value(p.norm * q.norm), 9) AS sim
  FROM prefs a JOIN prefs b ON a.ns = b.ns AND a.key = b.key AND a.user_id < b.user_id AND a.ns <> 'style' JOIN n p ON p.user_id = a.user_id JOIN n q ON q.user_id = b.user_id GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT user_id, other, sim, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS place
  FROM (SELECT a AS user_id, b AS other, sim FROM sims UNION ALL SELECT b, a, sim FROM sims) WHERE sim > 0) WHERE place <= 10)"""


def _sixth(x: Column) -> Column:
    """Rounded to the sixth place in doubles, as the SQL does: of nine places the last three are often 500, where decimals round otherwise."""
    return F.round(x * 1e6) / 1e6


@query(f"WITH {_SIMS} SELECT a, b, round(sim, 6) + 0.0 AS sim FROM sims", "prefs")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cosines(preferences(spark, sf_dir)).withColumn("sim", _sixth(F.round("sim", 9)) + 0.0)


@query(f"WITH {_SIMS} SELECT user_id, other, round(sim, 6) AS sim, place FROM near", "prefs")
def neighbors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.nearest(preferences(spark, sf_dir)).select("user_id", "other", _sixth(F.col("sim")).alias("sim"), F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_SIMS}, rated AS (SELECT user_id AS other, item_id AS id, arg_max(signal, event_id) AS signal FROM signals GROUP BY 1, 2),
s AS (SELECT n.user_id, r.id, list(CASE WHEN r.signal > 0 THEN 0.6 ELSE -0.3 END * n.sim ORDER BY n.place) AS steps FROM near n JOIN rated r ON r.other = n.other WHERE n.sim >= 0.15 GROUP BY 1, 2)
SELECT user_id, id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), steps), lambda b, x: CASE WHEN x > 0 THEN least(1.5, b + x) ELSE greatest(-1.5, b + x) END), 6) AS boost FROM s""",
    "signals",
    "prefs",
)
def collab_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = signals(spark, sf_dir).groupBy("user_id", F.col("item_id").alias("id")).agg(F.max_by("signal", "event_id").alias("signal"))
    return U.collab_boosts(U.nearest(preferences(spark, sf_dir)), ratings).withColumn("boost", _sixth(F.col("boost")))


_ANSWERS = """SELECT c_custkey AS user_id, unnest([{'q': 'categories', 'c': 'c' || (c_custkey % 7)}, {'q': 'categories', 'c': 'c' || (c_custkey % 4)}, {'q': 'communities', 'c': 'src' || c_nationkey},
  {'q': 'tags', 'c': lower(c_mktsegment)}, {'q': 'avoid', 'c': 'c' || (c_custkey % 5)}, {'q': 'tone', 'c': ['fun', 'serious', 'balanced'][c_custkey % 3 + 1]},
  {'q': 'depth', 'c': ['deep', 'quick', 'mixed'][c_custkey % 3 + 1]}], recursive := true) FROM customer"""
_SURVEY = f"""ans AS ({_ANSWERS}),
gives AS (SELECT user_id, 'category' AS ns, c AS key, 1.0 AS w FROM ans WHERE q = 'categories' UNION ALL SELECT user_id, 'source', c, 1.5 FROM ans WHERE q = 'communities'
  UNION ALL SELECT user_id, 'tag', c, 1.2 FROM ans WHERE q = 'tags' UNION ALL SELECT user_id, 'category', c, -1.5 FROM ans WHERE q = 'avoid'
  UNION ALL SELECT user_id, 'category', 'humor', CASE c WHEN 'fun' THEN 0.8 ELSE -0.5 END FROM ans WHERE q = 'tone' AND c IN ('fun', 'serious')
  UNION ALL SELECT user_id, 'tag', 'meme', 0.6 FROM ans WHERE q = 'tone' AND c = 'fun'
  UNION ALL SELECT user_id, 'style', 'longform', CASE c WHEN 'deep' THEN 1 ELSE -1 END FROM ans WHERE q = 'depth' AND c IN ('deep', 'quick')),
survey AS (SELECT user_id, ns, key, CAST(sum(w) AS DOUBLE) AS weight FROM gives GROUP BY ALL)"""


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    # spread by reader while a reader is one row: a small file is one task, which would hold the sums of all readers
    said = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_custkey", "c_nationkey", "c_mktsegment").repartition("user_id").selectExpr(
        "user_id",
        """explode(array(array('categories', concat('c', c_custkey % 7)), array('categories', concat('c', c_custkey % 4)), array('communities', concat('src', c_nationkey)),
        array('tags', lower(c_mktsegment)), array('avoid', concat('c', c_custkey % 5)), array('tone', element_at(array('fun', 'serious', 'balanced'), int(c_custkey % 3 + 1))),
        array('depth', element_at(array('deep', 'quick', 'mixed'), int(c_custkey % 3 + 1))))) AS a""",
    )
    return U.survey_weights(said.selectExpr("user_id", "a[0] AS question", "a[1] AS choice"))


@query(f"WITH {_SURVEY} SELECT user_id, ns, key, round(weight, 6) AS weight FROM survey")
def survey_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survey(spark, sf_dir).withColumn("weight", F.round("weight", 6))


#: Rules of the test texts and hosts.
HOSTS = [(1, "example.com", "src1", "c1"), (2, "example.net", "src2", "c2"), (3, "example", "src3", "c3"), (4, "org", None, "c4")]
RULES = [("the", 1, "c4", "alpha"), ("tion", 1, "c4", "alpha"), ("und", 2, "c5", None), ("des", 3, None, "beta"), ("la", 3, None, "beta")]
_VALUES = "(VALUES {}) t({})"
_HISTORY = f"""visits AS (SELECT page_id AS visit_id, page_id % 50 AS user_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host,
  lower(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)) AS title, CAST(least(page_id % 30 + 1, 20) AS DOUBLE) AS w FROM pages),
hosts AS (SELECT * FROM {_VALUES.format("(1, 'example.com', 'src1', 'c1'), (2, 'example.net', 'src2', 'c2'), (3, 'example', 'src3', 'c3'), (4, 'org', NULL, 'c4')", 'place, match, source, category')}),
rules AS (SELECT * FROM {_VALUES.format("('the', 1, 'c4', 'alpha'), ('tion', 1, 'c4', 'alpha'), ('und', 2, 'c5', NULL), ('des', 3, NULL, 'beta'), ('la', 3, NULL, 'beta')", 'word, rule, category, tag')}),
firsts AS (SELECT * FROM (SELECT v.user_id, w, source, category, row_number() OVER (PARTITION BY visit_id ORDER BY place) AS r FROM visits v JOIN hosts h ON contains(v.host, h.match)) WHERE r = 1),
hit AS (SELECT DISTINCT visit_id, user_id, w, rule, category, tag FROM visits JOIN rules ON contains(title, word)),
parts AS (SELECT user_id, 'source' AS ns, source AS key, 0.6 * w AS x FROM firsts UNION ALL SELECT user_id, 'category', category, 0.4 * w FROM firsts
  UNION ALL SELECT user_id, 'category', category, 0.35 * w FROM hit UNION ALL SELECT user_id, 'tag', tag, 0.5 * w FROM hit),
history AS (SELECT user_id, ns, key, floor(least(3, sum(x)) * 100 + 0.5) / 100 AS weight FROM parts WHERE key IS NOT NULL GROUP BY ALL)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.functions.text import url_host

    visits = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("visit_id"), (F.col("page_id") % 50).alias("user_id"), url_host(F.col("url")).alias("host"),
        F.regexp_extract("html", r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1).alias("title"), (F.col("page_id") % 30 + 1).alias("n"),
    )
    hosts = spark.createDataFrame(HOSTS, "place int, match string, source string, category string")
    return U.history_weights(visits, hosts, spark.createDataFrame(RULES, "word string, rule int, category string, tag string"))


@query(f"WITH {_HISTORY} SELECT user_id, ns, key, CAST(weight AS DOUBLE) AS weight FROM history")
def history_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query(
    f"WITH {_SURVEY}, {_HISTORY} SELECT user_id, ns, key, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM (SELECT * FROM survey UNION ALL SELECT user_id, ns, key, weight * 0.5 FROM history) GROUP BY ALL"
)
def vector_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.merged_weights(_survey(spark, sf_dir), _history(spark, sf_dir), 0.5).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {_TASTE}, m AS (SELECT user_id, source, avg(taste) AS m FROM taste WHERE source IS NOT NULL GROUP BY 1, 2),
w AS (SELECT user_id, avg(m) AS centre, max(m) - min(m) AS spread, count(*) AS n FROM m GROUP BY 1)
SELECT user_id, source, round(greatest(0.5, least(2, 1 + greatest(-1, least(1, (m - centre) / spread * 2)))), 5) AS quota FROM m JOIN w USING (user_id) WHERE n > 1 AND spread > 0""",
    "prefs",
)
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tagged_items(spark, sf_dir)
    rows = U.taste_scores(_pairs(spark, sf_dir), known, preferences(spark, sf_dir)).join(known.select("id", "source"), "id").filter("source is not null")
    return U.source_quotas(rows).withColumn("quota", F.round("quota", 5))


def learning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes and dislikes, and what other events tell without a word, with the steps they make."""
    kind = "CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'dwell' END"
    rows = met_items(spark, sf_dir).selectExpr("user_id", "item_id AS id", "event_id AS ord", f"{kind} AS kind", "if(value >= 50, 1, -1) AS signal", "value * 1000 AS dwell_ms")
    met = rows.join(items(spark, sf_dir).select("id", "words"), "id")
    step = F.when(F.col("kind").isNull(), U.feedback_step(F.col("signal"))).otherwise(U.implicit_step(F.col("kind"), F.col("dwell_ms"), F.col("words")))
    return met.select("user_id", "id", "ord", step.alias("step"))


#: Every weight's own steps with their places among the reader's events, folded; the fold's state is {w, pos}.
LEARNT_SQL = """WITH k AS (SELECT event_id, user_id, event_id % (SELECT count(*) FROM documents) AS id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'dwell' END AS kind, value FROM events),
e AS (SELECT user_id, k.event_id, category, source, tags, words, CASE k.kind WHEN 'open' THEN 0.12 * 0.3 WHEN 'complete' THEN 0.12 WHEN 'skip' THEN -0.12 * 0.6
    WHEN 'dwell' THEN 0.12 * greatest(-1, least(1, (value * 1000 / greatest(4000, least(60000, greatest(20, coalesce(words, 40)) * 180.0)) - 0.4) / 0.6)) ELSE CASE WHEN value >= 50 THEN 0.35 ELSE -0.35 END END AS step
  FROM k JOIN tagged t ON k.id = t.id),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE step <> 0),
m AS (SELECT user_id, 'category' AS ns, category AS key, pos, n, step * 0.25 AS step FROM p
  UNION ALL SELECT user_id, 'source', source, pos, n, step * 0.7 FROM p WHERE source IS NOT NULL
  UNION ALL SELECT user_id, 'tag', unnest(tags), pos, n, step FROM p
  UNION ALL SELECT user_id, 'style', 'longform', pos, n, step * 0.3 * CASE WHEN words >= 400 THEN 1 ELSE -1 END FROM p WHERE words >= 400 OR words <= 120),
l AS (SELECT user_id, ns, key, any_value(n) AS n, list({'w': CAST(step AS DOUBLE), 'pos': pos} ORDER BY pos) AS s FROM m GROUP BY 1, 2, 3),
f AS (SELECT user_id, ns, key, n, list_reduce(list_prepend({'w': CAST(0 AS DOUBLE), 'pos': CAST(0 AS BIGINT)}, s), lambda a, b: {
    'w': greatest(CASE ns WHEN 'style' THEN -2.0 ELSE -6.0 END, least(CASE ns WHEN 'style' THEN 2.0 ELSE 6.0 END,
      b.w + CASE WHEN ns = 'style' THEN a.w WHEN abs(a.w * pow(0.995, b.pos - a.pos)) < 0.02 THEN 0 ELSE a.w * pow(0.995, b.pos - a.pos) END)), 'pos': b.pos}) AS r FROM l),
o AS (SELECT user_id, ns, key, CASE WHEN ns = 'style' OR n = r.pos THEN r.w WHEN abs(r.w * pow(0.995, n - r.pos)) < 0.02 THEN 0 ELSE r.w * pow(0.995, n - r.pos) END AS weight FROM f)
SELECT user_id, ns, key, round(weight, 6) AS weight FROM o WHERE weight <> 0 OR ns = 'style'"""


@query(LEARNT_SQL, "tagged")
def online_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after all events of each reader; the tests fold them one by one too."""
    return U.learned_weights(learning_events(spark, sf_dir), tagged_items(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_GATED = """raw AS (SELECT *, CAST(score + 2 * comment_count AS DOUBLE) AS e, epoch(TIMESTAMP '2024-01-31 00:00:00' - published_at) / 3600.0 AS hours FROM items),
ranked AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, max(e) OVER (PARTITION BY source) AS top, row_number() OVER (PARTITION BY source ORDER BY e DESC, ord) - 1 AS place FROM raw),
gate AS (SELECT id FROM ranked WHERE top <= 0 OR place < greatest(1, ceil(n * 0.6)))"""


@query(
    f"""WITH {_TASTE}, {_GATED}, mine AS (SELECT t.user_id, t.id, taste + 0.5 * log10(1 + t.score + t.comment_count * 1.5) / 3 + 0.6 * exp(-age / 72) + ({_HASH.replace('CAST(id', 'CAST(t.id')} % 1000 / 1000.0 - 0.5) * 0.2 AS score
  FROM taste t JOIN gate g ON g.id = t.id WHERE t.id % 5 > 0),
good AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM mine WHERE round(score, 6) >= 1)
SELECT user_id, n, rank, id FROM good WHERE rank <= 5""",
    "items",
    "prefs",
)
def user_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a reader: unseen hot items that score one or more, their number and the first five."""
    pairs = _pairs(spark, sf_dir).filter("id % 5 > 0")
    hot_ones = hot.hot_gate(items(spark, sf_dir), F.expr(NOW)).select("id")
    scored = U.item_scores(pairs.join(hot_ones, "id", "left_semi"), tagged_items(spark, sf_dir), preferences(spark, sf_dir), F.expr(NOW), explore=0.0)
    good = scored.withColumn("score", F.round("score", 6)).filter("score >= 1")
    whole = good.groupBy("user_id").agg(F.count("*").alias("n"))
    return U.ranked(good, "user_id", "score", 5).join(whole, "user_id").select("user_id", "n", F.col("rank").cast("long").alias("rank"), "id")
