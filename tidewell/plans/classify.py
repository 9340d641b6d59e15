"""Queries of text features and classification, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import classify as K
from tidewell.operators.gates import RUDE_MASK, masked
from tidewell.plans.base import Catalogue
from tidewell.plans.gates import RUDE, _TOLD, told_items
from tidewell.sources.adapters import STOP, items, table

CATALOGUE = Catalogue()
query = CATALOGUE.query

_CLEAN = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(title, ''), '\s+-\s+[^-]{1,30}$', ''), '^\s*[\[({【〈<][^\])}】〉>]{0,12}[\])}】〉>]\s*', '')), '[^0-9a-z가-힣 ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_FEATS = f"list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '')"


@query(f"SELECT id, array_to_string({_FEATS}, ' ') AS features FROM items", "items")
def title_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test titles have no Hangul, so their features are whole words; the tests hold the grams of Hangul words."""
    return items(spark, sf_dir).select("id", F.array_join(T.title_features(F.col("title")), " ").alias("features"))


#: Labels are the documents' languages; one document in five is held out.
_NB = f"""f AS (SELECT id, lang AS label, {_FEATS} AS feats, CASE WHEN id % 7 = 0 THEN 0.3 ELSE 1.0 END AS weight, id % 5 = 0 AS held FROM items),
e AS (SELECT label, weight, unnest(feats) AS feature FROM f WHERE NOT held AND label IS NOT NULL AND len(feats) >= 2),
c AS (SELECT label, feature, CAST(sum(CAST(weight AS DOUBLE)) AS DOUBLE) AS w FROM e GROUP BY ALL)"""
_PREDICT = f"""{_NB}, tot AS (SELECT label, sum(w) AS total FROM c GROUP BY 1), voc AS (SELECT count(DISTINCT feature) AS v FROM c), words AS (SELECT DISTINCT feature FROM c),
held AS (SELECT id, label, feats, len(feats) AS n FROM f WHERE held), p AS (SELECT id, unnest(feats) AS feature FROM held),
hits AS (SELECT p.id, c.label, sum(ln(w + 1)) AS s FROM p JOIN c USING (feature) GROUP BY ALL),
kn AS (SELECT id, count(*) AS k FROM p JOIN words USING (feature) GROUP BY 1),
s AS (SELECT h.id, h.n, t.label, round(coalesce(x.s, 0) - h.n * ln(t.total + v), 9) AS score FROM held h CROSS JOIN tot t CROSS JOIN voc LEFT JOIN hits x ON x.id = h.id AND x.label = t.label WHERE h.n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM s),
b AS (SELECT id, any_value(n) AS n, max(label) FILTER (r = 1) AS label, max(score) FILTER (r = 1) - max(score) FILTER (r = 2) AS lead FROM r GROUP BY 1),
pred AS (SELECT h.id, h.label AS truth, b.label, coalesce(lead / b.n, 0) AS margin, coalesce(k, 0) / greatest(h.n, 1) AS known FROM held h LEFT JOIN b USING (id) LEFT JOIN kn USING (id))"""


def _learnt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = items(spark, sf_dir).select("id", F.col("lang").alias("label"), T.title_features(F.col("title")).alias("features"), F.expr("if(id % 7 = 0, 0.3D, 1.0D)").alias("weight"))
    return rows.filter("id % 5 = 0"), K.feature_counts(rows.filter("id % 5 != 0"))


@query(f"WITH {_NB} SELECT label, feature, round(w, 6) AS w FROM c", "items")
def nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learnt(spark, sf_dir)[1].withColumn("w", F.round("w", 6))


@query(f"WITH {_PREDICT} SELECT id, CASE WHEN margin >= 0.08 AND known >= 0.2 THEN label END AS label, round(margin, 6) AS margin, round(known, 6) AS known FROM pred", "items")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, counts = _learnt(spark, sf_dir)
    return K.answered(K.predictions(held, counts)).select("id", "label", F.round("margin", 6).alias("margin"), F.round("known", 6).alias("known"))


@query(
    f"WITH {_PREDICT}, a AS (SELECT truth AS label, CASE WHEN margin >= 0.08 AND known >= 0.2 THEN label END AS said FROM pred) SELECT label, count(*) AS n, count(said) AS answered, count(*) FILTER (said = label) AS \"right\" FROM a GROUP BY 1",
    "items",
)
def nb_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, counts = _learnt(spark, sf_dir)
    said = K.answered(K.predictions(held, counts)).select("id", F.col("label").alias("said"))
    return K.holdout_quality(held.select("id", "label").join(said, "id"))


#: Word lists of the test texts.
LISTS = {"auto": ["thing", "oueau"], "alpha": ["the", "and", "ing"], "beta": ["und", "ich", "der"], "gamma": ["que", "eau", "la "]}
GUARDS = {"auto": ["tion"], "alpha": ["ther"]}
INCIDENTS = ["ererer", "nenene"]


def _hits(words: list[str], text: str = "lower(title)") -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words)


_KEYWORD = f"""n AS (SELECT *, CASE WHEN contains(title, 'ther') THEN 0 ELSE {_hits(LISTS['alpha'])} END AS a, {_hits(LISTS['beta'])} AS b, {_hits(LISTS['gamma'])} AS g FROM told),
kw AS (SELECT *, CASE WHEN contains(title, 'ererer') OR contains(title, 'nenene') THEN NULL WHEN contains(lower(title), 'thing') OR contains(lower(title), 'oueau') THEN CASE WHEN contains(title, 'tion') THEN NULL ELSE 'auto' END
  WHEN a > b AND a > g THEN 'alpha' WHEN b > a AND b > g THEN 'beta' WHEN g > a AND g > b THEN 'gamma' END AS keyword FROM n)"""


@query(f"WITH {_TOLD}, {_KEYWORD} SELECT id, keyword AS category FROM kw", "items")
def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", T.keyword_category(F.col("title"), LISTS, GUARDS, "auto", INCIDENTS).alias("category"))


@query(
    f"""WITH {_TOLD}, {_KEYWORD}, {_PREDICT}, pp AS (SELECT id, CASE WHEN margin >= 0.08 AND known >= 0.2 THEN CASE label WHEN 'en' THEN 'alpha' WHEN 'de' THEN 'beta' END END AS said FROM pred),
m AS (SELECT kw.*, CASE WHEN source = 'src4' AND id % 3 = 0 AND contains('/b/' || (id % 20), '/1') THEN 'board' END AS board, kind = 'news' AND category <> 'c0' AS sectioned, said FROM kw LEFT JOIN pp USING (id))
SELECT id, CASE WHEN list_contains(topics, 'politics') OR category = 'c6' THEN category WHEN board IS NOT NULL THEN board WHEN (CASE WHEN sectioned THEN CASE WHEN keyword = 'auto' THEN keyword END ELSE keyword END) IS NOT NULL THEN keyword
  WHEN sectioned THEN category WHEN said IS NOT NULL AND said <> category THEN said WHEN source = 'src3' AND category = 'c1' THEN 'c2' WHEN source = 'src5' THEN 'humor' ELSE category END AS category FROM m WHERE title IS NOT NULL AND source IS NOT NULL""",
    "items",
)
def classification_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, counts = _learnt(spark, sf_dir)
    said = K.answered(K.predictions(held, counts)).select("id", F.expr("CASE label WHEN 'en' THEN 'alpha' WHEN 'de' THEN 'beta' END").alias("said"))
    rows = told_items(spark, sf_dir).filter("title is not null and source is not null").join(said, "id", "left")
    keyword = T.keyword_category(F.col("title"), LISTS, GUARDS, "auto", INCIDENTS)
    sectioned = F.expr("kind = 'news' and category != 'c0'")
    board = F.when((F.col("source") == "src4") & F.coalesce(F.col("url").rlike("/1"), F.lit(False)), "board")
    settled = K.cascade(
        F.col("category"), F.lit("c1"), sectioned, F.col("topics"), board, F.when(sectioned, F.when(keyword == "auto", keyword)).otherwise(keyword), F.col("said"), F.lit(100),
        ["alpha", "beta"], ["c6"], F.when(F.col("source") == "src3", "c2"), F.col("source") == "src5",
    )
    return rows.select("id", settled.alias("category"))


def _tags_sql(words: list[str], short: list[str], most: int = 8) -> str:
    """Words of a list claim their first places, longest first; then tokens that none of them is."""
    ordered = sorted({w for w in words if len(w) > 1}, key=lambda w: (-len(w), w))
    places = ", ".join(f"{{'w': '{w}', 's': instr(t, '{w.lower()}'), 'n': {len(w)}}}" for w in ordered)
    stop, few = (", ".join(f"'{w}'" for w in ws) for ws in (STOP, short))
    return f"""WITH l AS (SELECT id, lower(coalesce(title, '')) AS t FROM items),
m AS (SELECT id, t, list_filter([{places}], lambda x: x.s > 0) AS met FROM l),
c AS (SELECT id, t, list_transform(list_reduce(list_prepend(list_filter(met, lambda x: false), list_transform(met, lambda x: [x])),
    lambda held, x: CASE WHEN len(held) >= {most} OR len(list_filter(held, lambda h: x[1].s < h.s + h.n AND x[1].s + x[1].n > h.s)) > 0 THEN held ELSE list_concat(held, x) END), lambda x: x.w) AS claimed FROM m),
k AS (SELECT id, claimed, list_filter(regexp_extract_all(t, '[a-z][a-z0-9]{{1,15}}'), lambda w: w NOT IN ({stop}) AND (length(w) > 2 OR w IN ({few})) AND NOT list_contains(list_transform(claimed, lambda c: lower(c)), w)) AS mine FROM c),
n AS (SELECT id, claimed, list_transform(list_filter(list_transform(range(1, len(mine) + 1), lambda i: {{'w': mine[i], 'first': list_position(mine, mine[i]) = i}}), lambda x: x.first), lambda x: x.w) AS mine FROM k)
SELECT id, coalesce(array_to_string(list_concat(claimed, mine)[1:{most}], ','), '') AS tags FROM n"""


@query(_tags_sql([w for ws in LISTS.values() for w in ws], ["ai", "is"]), "items")
def dictionary_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of titles by a dictionary, longest words first, then latin tokens; each claim depends on those before."""
    words = [w for ws in LISTS.values() for w in ws]
    return items(spark, sf_dir).select("id", F.array_join(T.dictionary_tags(F.col("title"), words, STOP, ["ai", "is"]), ",").alias("tags"))


@query("SELECT id, replace(replace(title, 'eaueau', 'e●●●●●'), 'thth', 't●●●') AS title, contains(title, 'thth') OR contains(title, 'eaueau') AS rude FROM items", "items")
def masked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.functions.text import contains_any

    return items(spark, sf_dir).select("id", masked(F.col("title"), RUDE[::-1], RUDE_MASK).alias("title"), F.coalesce(contains_any(F.col("title"), RUDE), F.lit(False)).alias("rude"))


@query(
    r"""WITH r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a&nbsp;b&lt;' WHEN 1 THEN '&#65;&#x42;&amp;lt;' WHEN 2 THEN '&HELLIP;&unknown;&euro;' WHEN 3 THEN 'plain' WHEN 4 THEN '&#1114112;x&#128512;' ELSE '&amp;amp;&#0038;' END || page_id AS t FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a b<' WHEN 1 THEN 'AB&lt;' WHEN 2 THEN '…&unknown;€' WHEN 3 THEN 'plain' WHEN 4 THEN 'x😀' ELSE '&amp;&' END || page_id AS t FROM r"""
)
def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE page_id % 6 WHEN 0 THEN 'a&nbsp;b&lt;' WHEN 1 THEN '&#65;&#x42;&amp;lt;' WHEN 2 THEN '&HELLIP;&unknown;&euro;' WHEN 3 THEN 'plain' WHEN 4 THEN '&#1114112;x&#128512;' ELSE '&amp;amp;&#0038;' END"
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(F.expr(f"concat({raw}, page_id)")).alias("t"))


@query(
    r"""WITH a AS (SELECT id, trim(coalesce('[first] ' || title, ''), ' ') AS x FROM items),
m AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(x, '^\s*[\[【(<][^\]】)>]{0,12}[\]】)>]\s*', ''), '^\s*[\[【(<][^\]】)>]{0,12}[\]】)>]\s*', ''), '^\s*[\[【(<][^\]】)>]{0,12}[\]】)>]\s*', '') AS x FROM a),
p AS (SELECT id, coalesce(list_filter(list_transform(regexp_split_to_array(x, '[…·|]|—|\.\.\.|\s-\s'), lambda y: trim(y, ' ')), lambda y: y <> '')[1], '') AS x FROM m),
q AS (SELECT id, regexp_replace(regexp_replace(x, '^["“''‘\s]+', ''), '["”''’\s]+$', '') AS x FROM p),
c AS (SELECT id, x, substring(x, 1, 20) AS cut, 20 - instr(reverse(substring(x, 1, 20)), ' ') AS blank FROM q),
s AS (SELECT id, CASE WHEN length(x) <= 20 THEN x ELSE trim(CASE WHEN contains(cut, ' ') AND blank >= 8 THEN left(cut, CAST(blank AS BIGINT)) ELSE cut END, ' ') END AS x FROM c),
t AS (SELECT id, CASE WHEN len(regexp_extract_all(x, '[“‘]')) <> len(regexp_extract_all(x, '[”’]')) THEN regexp_replace(x, '[“”‘’]', '', 'g') ELSE x END AS x FROM s),
u AS (SELECT id, CASE WHEN len(regexp_extract_all(x, '["'']')) % 2 = 1 THEN regexp_replace(x, '["'']', '', 'g') ELSE x END AS x FROM t)
SELECT id, trim(regexp_replace(x, '[\s,·、:;–—-]+$', ''), ' ') AS phrase FROM u""",
    "items",
)
def lead_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", T.lead_phrase(F.concat(F.lit("[first] "), F.col("title"))).alias("phrase"))
