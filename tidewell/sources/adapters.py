"""Canonical relations over the test tables: items, track events, signals, preferences, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
#: Hosts and users are spread over so many groups in derived columns.
CATEGORIES = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items. src0 and src1 carry no signal. ``title`` is the first line, ``ord`` the arrival order."""
    signal = "source NOT IN ('src0', 'src1')"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "source",
        "lang",
        "substring(split_part(text, '\n', 1), 1, 300) AS title",
        "substring(text, 1, 200) AS summary",
        "length(text) AS length",
        r"coalesce(regexp_count(text, '[^ \t\n\r]+'), 0) AS words",
        f"concat('c', doc_id % {CATEGORIES}) AS category",
        "if(doc_id % 3 = 0, 'news', 'community') AS kind",
        f"if({signal}, doc_id * 37 % 101, 0) AS score",
        f"if({signal}, doc_id * 53 % 67, 0) AS comment_count",
        "doc_id % 6 AS coverage",
        f"{NOW} - make_dt_interval(0, int(doc_id * 7919 % 72)) AS published_at",
        "doc_id AS ord",
    )


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracking events; day is the Korean calendar day, k the number in props."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        "cast(ts AS timestamp) AS ts",
        "to_date(cast(ts AS timestamp) + interval 9 hours) AS day",
        "CASE event_type WHEN 'view' THEN 'view' WHEN 'signup' THEN 'view' WHEN 'error' THEN 'exit' WHEN 'click' THEN 'click' ELSE 'ad_click' END AS type",
        "event_type = 'signup' AS entry",
        "value",
        "cast(get_json_object(props, '$.k') AS bigint) AS k",
        "cast(floor(value * 1000) AS bigint) AS dwell_ms",
    )


def met_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with item_id: the document that each meets, by its id's place among as many as there are."""
    there = table(spark, sf_dir, "documents").agg(F.count("*").alias("__n"))
    rows = table(spark, sf_dir, "events").crossJoin(F.broadcast(there))
    return rows.withColumn("item_id", F.expr("event_id % nullif(__n, 0)")).drop("__n")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, signal, ts, event_id): a like for values from 50 on, else a dislike."""
    return met_items(spark, sf_dir).selectExpr("user_id", "item_id", "if(value >= 50, 1, -1) AS signal", "cast(ts AS timestamp) AS ts", "event_id")


#: Words that name no subject in the test texts.
STOP = ["the", "of", "and", "that", "with", "for", "this", "was", "que", "des", "les", "der", "die", "und", "den", "los", "las"]


def tagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items`` with all tags of the title."""
    from tidewell.functions.text import latin_tags

    return items(spark, sf_dir).withColumn("tags", latin_tags(F.col("title"), STOP, 1 << 20))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ns, key, weight): a tenth of the summed signals by category, source and tag of the items, and by their length as a style."""
    from tidewell.operators.taste import rated_features

    rated = signals(spark, sf_dir).select("user_id", F.col("item_id").alias("id"), "signal")
    weight = F.col("x") / 10.0
    held = F.when(F.col("ns") == "style", F.least(F.lit(2.0), F.greatest(F.lit(-2.0), weight))).otherwise(weight)
    return rated_features(rated, tagged_items(spark, sf_dir)).select("user_id", "ns", "key", held.alias("weight"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source with label, enabled, adult, max_age_h, lean and feed group."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "source",
            "upper(source) AS label",
            "int(substring(source, 4)) AS no",
            "int(substring(source, 4)) % 7 != 3 AS enabled",
            "int(substring(source, 4)) % 11 = 5 AS adult",
            "CASE int(substring(source, 4)) % 4 WHEN 0 THEN 12 WHEN 1 THEN 60 END AS max_age_h",
            "int(substring(source, 4)) % 3 - 1 AS lean",
            "if(int(substring(source, 4)) % 5 = 0, 'group5', null) AS feed_group",
            "int(substring(source, 4)) % 13 = 4 AS off_main",
            "element_at(array('kr', 'us', 'jp'), int(substring(source, 4)) % 3 + 1) AS country",
        )
    )


#: The same relations in the checking dialect.
VIEWS = {
    "items": """
      SELECT doc_id AS id, source, lang, substring(split_part(text, chr(10), 1), 1, 300) AS title,
             substring(text, 1, 200) AS summary, length(text) AS length, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS words, 'c' || (doc_id % 7) AS category,
             CASE WHEN doc_id % 3 = 0 THEN 'news' ELSE 'community' END AS kind,
             CASE WHEN source NOT IN ('src0', 'src1') THEN doc_id * 37 % 101 ELSE 0 END AS score,
             CASE WHEN source NOT IN ('src0', 'src1') THEN doc_id * 53 % 67 ELSE 0 END AS comment_count,
             doc_id % 6 AS coverage,
             TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id * 7919 % 72 AS INTEGER)) AS published_at,
             doc_id AS ord
      FROM documents""",
    "track": """
      SELECT event_id, user_id, ts, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day,
             CASE event_type WHEN 'view' THEN 'view' WHEN 'signup' THEN 'view' WHEN 'error' THEN 'exit'
                             WHEN 'click' THEN 'click' ELSE 'ad_click' END AS type,
             event_type = 'signup' AS entry, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             CAST(floor(value * 1000) AS BIGINT) AS dwell_ms
      FROM events""",
    "signals": """
      SELECT user_id, event_id % (SELECT count(*) FROM documents) AS item_id, CASE WHEN value >= 50 THEN 1 ELSE -1 END AS signal, ts, event_id FROM events""",
    "tagged": f"""
      SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z][a-z0-9]{{1,15}}'), lambda t: length(t) > 2 AND t NOT IN ({", ".join(f"'{w}'" for w in STOP)}))) AS tags
      FROM items""",
    "feats": """
      SELECT id, 'category' AS ns, category AS key, CAST(1 AS DOUBLE) AS coef FROM tagged
      UNION ALL SELECT id, 'source', source, CAST(0.6 AS DOUBLE) FROM tagged WHERE source IS NOT NULL
      UNION ALL SELECT id, 'tag', unnest(tags), CAST(1.3 AS DOUBLE) / len(tags) FROM tagged""",
    "prefs": """
      SELECT user_id, ns, key, sum(signal) / CAST(10 AS DOUBLE) AS weight FROM signals s JOIN feats f ON s.item_id = f.id GROUP BY ALL
      UNION ALL SELECT user_id, 'style', 'longform', least(2, greatest(-2, sum(signal * CASE WHEN words >= 400 THEN 1 WHEN words <= 120 THEN -1 ELSE 0 END) / CAST(10 AS DOUBLE)))
      FROM signals s JOIN tagged t ON s.item_id = t.id GROUP BY 1""",
    "registry": """
      SELECT DISTINCT source, upper(source) AS label, CAST(substring(source, 4) AS INTEGER) AS no,
             CAST(substring(source, 4) AS INTEGER) % 7 <> 3 AS enabled, CAST(substring(source, 4) AS INTEGER) % 11 = 5 AS adult,
             CASE CAST(substring(source, 4) AS INTEGER) % 4 WHEN 0 THEN 12 WHEN 1 THEN 60 END AS max_age_h,
             CAST(substring(source, 4) AS INTEGER) % 3 - 1 AS lean,
             CASE WHEN CAST(substring(source, 4) AS INTEGER) % 5 = 0 THEN 'group5' END AS feed_group,
             CAST(substring(source, 4) AS INTEGER) % 13 = 4 AS off_main, ['kr', 'us', 'jp'][CAST(substring(source, 4) AS INTEGER) % 3 + 1] AS country
      FROM documents""",
}


_NEEDS = {"tagged": ["items"], "feats": ["tagged"], "prefs": ["signals", "feats"]}


def oracle(body: str, *views: str) -> str:
    """``body`` with the canonical relations it names, and those that these need, put before it."""
    wanted = list(views)
    for v in wanted:
        wanted += [x for x in _NEEDS.get(v, []) if x not in wanted]
    # what several parts of a query join is made once, so that no plan makes it again for every row
    made = {n: "AS MATERIALIZED" if n in ("tagged", "feats", "prefs") else "AS" for n in VIEWS}
    with_ = ",\n".join(f"{n} {made[n]} ({VIEWS[n]})" for n in VIEWS if n in wanted)
    body = body.strip()
    if not with_:
        return body
    for opening in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(opening):
            return f"{opening} {with_}, {body[len(opening) :].lstrip()}"
    return f"WITH {with_}\n{body}"
