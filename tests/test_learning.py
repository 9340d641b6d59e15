"""Folds that SQL doesn't say, event by event, and text functions on hand-made texts."""

from pyspark.sql import functions as F

from tidewell.functions import maths as M
from tidewell.functions import text as T
from tidewell.operators import taste as U
from tidewell.plans import taste
from tidewell.sources.adapters import tagged_items

SF = "/root/testdata/sf0.001"


def test_online_learning_is_the_fold(spark):
    items = {r["id"]: r for r in tagged_items(spark, SF).select("id", "category", "source", "tags", "words").collect()}
    events = sorted((r["user_id"], r["ord"], r["id"], r["step"]) for r in taste.learning_events(spark, SF).collect())
    weights: dict = {}
    for user, _, item, step in events:
        if step == 0:
            continue
        mine = weights.setdefault(user, {})
        for k in list(mine):
            if k[0] != "style":
                mine[k] *= 0.995
                if abs(mine[k]) < 0.02:
                    del mine[k]
        i = items[item]
        moves = [(("category", i["category"]), step * 0.25, 6), *((("tag", t), step, 6) for t in i["tags"])]
        moves += [(("source", i["source"]), step * 0.7, 6)] if i["source"] else []
        long = 1 if i["words"] >= 400 else -1 if i["words"] <= 120 else 0
        moves += [(("style", "longform"), step * 0.3 * long, 2)] if long else []
        for k, by, most in moves:
            mine[k] = max(-most, min(most, mine.get(k, 0.0) + by))
    want = {(u, *k): w for u, mine in weights.items() for k, w in mine.items()}
    got = {(r["user_id"], r["ns"], r["key"]): r["weight"] for r in taste.online_learning(spark, SF).collect()}
    assert set(got) == set(want) and all(abs(got[k] - w) < 1e-6 for k, w in want.items())


def test_boosts_are_held_after_each_step(spark):
    near = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 0.9, 2), (1, 4, 0.9, 3), (1, 5, 0.8, 4), (1, 6, 0.1, 5)], "user_id long, other long, sim double, place int")
    ratings = spark.createDataFrame([(2, 7, 1), (3, 7, 1), (4, 7, 1), (5, 7, -1), (6, 7, 1)], "user_id long, id long, signal int")
    row = U.collab_boosts(near, ratings).first()
    assert abs(row["boost"] - (1.5 - 0.24)) < 1e-9


def test_text_functions(spark):
    def one(column, *values):
        names = [f"c{i}" for i in range(len(values))]
        return spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True))).select(column.alias("x")).first()["x"]

    assert one(T.title_features(F.col("c0")), "[속보] SK하이닉스 실적 - 매체") == ["sk", "k하", "하이", "이닉", "닉스", "실적"]
    assert one(T.title_features(F.col("c0")), "반도체 ai 가") == ["반도", "도체", "반도체", "ai", "가"]
    assert one(T.dictionary_tags(F.col("c0"), ["전기차", "전기차 충전", "충전"], ["the"], ["ai"]), "전기차 충전 the AI xx chatgpt") == ["전기차 충전", "ai", "chatgpt"]
    assert one(T.lead_phrase(F.col("c0")), "[단독](종합) 여러 낱말로 된 아주 긴 제목이 여기 있다 … 부제") == "여러 낱말로 된 아주 긴 제목이"
    # digits at the ends of parts stay; blanks with a mark on them, vertical tabs and line separators are no white space
    for title, phrase in [("00 jours 0 - 11", "00 jours 0"), (" … a", "a"), ("abc\x0b - d", "abc\x0b"), ("abc\"\u2028", "abc\u2028"), ("abcdefghij k \u0301lmnopqrs", "abcdefghij k")]:
        assert one(T.lead_phrase(F.col("c0")), title) == phrase
    assert one(T.tidy_phrase(F.col("c0")), "이 대통령 “북한과 대결, ") == "이 대통령 북한과 대결"
    assert one(T.mentions(F.col("c0"), F.lit("ai")), "he said so") is False and one(T.mentions(F.col("c0"), F.lit("ai")), "AI, now") is True
    assert one(T.mentions(F.col("c0"), F.lit("재건축")), "재건축이 온다") is True and one(T.mentions(F.col("c0"), F.lit("법")), "방법") is False
    assert one(M.times31(F.col("c0")), "a😀") == (97 * 31 * 31 + 0xD83D * 31 + 0xDE00) % 2**32
    assert one(M.fnv1a(F.col("c0")), "") == 2166136261 and one(M.fnv1a(F.col("c0")), "abc") == 440920331 and one(M.base36(F.lit(440920331)), "x") == "7aigaz"
    assert one(T.decode_entities(F.col("c0")), "&#xD800;&#0;x&amp;nbsp;") == "\x00x&nbsp;"
    assert one(T.excerpt(F.col("c0"), 5, "…"), "123456") == "1234…" and one(T.excerpt(F.col("c0"), 6, "…"), "123456") == "123456"


def test_unknown_ages_are_neutral(spark):
    from tidewell.operators import hot

    now = F.expr("timestamp '2024-01-02 00:00:00'")
    rows = spark.createDataFrame([(0, 0)], "score int, comment_count int").withColumn("published_at", F.lit(None).cast("timestamp"))
    row = rows.select(hot.hot_age(now).alias("age"), hot.freshness(hot.hours_between(now, F.col("published_at"))).alias("fresh"), hot.hotness(now).alias("hot")).first()
    assert (row["age"], row["fresh"], row["hot"]) == (12.0, 0.5, 0.3)


def test_subjects_fall_back_to_the_first_phrase(spark):
    from tidewell.operators.publish import issue_subjects

    rows = [(1, 0, "삼성 반도체 실적"), (1, 1, "반도체 삼성 전망"), (2, 0, "[속보] 혼자 나온 제목 … 부제")]
    got = {r["issue"]: r["subject"] for r in issue_subjects(spark.createDataFrame(rows, "issue long, place long, title string"), ["issue"]).collect()}
    assert got == {1: "삼성 반도체", 2: "혼자 나온 제목"}


def test_times_as_list_pages_print_them(spark):
    from tidewell.functions.dates import list_time

    want = {
        "07:30": "2024-01-30 07:30:00", "23:59": "2024-01-30 23:59:00", "12:34:56": "2024-01-30 12:34:56", "00:01": "2024-01-31 00:01:00", "1-30 22:10": "2024-01-30 22:10:00", "02/03 04:05": "2023-02-03 04:05:00",
        "3시간 전": "2024-01-30 21:00:00", "15 분 전": "2024-01-30 23:45:00", "2일": "2024-01-29 00:00:00", "24.01.15": "2024-01-15 00:00:00", "24/01/30": "2024-01-30 00:00:00",
        "2024-01-02 03:04:05": "2024-01-02 03:04:05", "25.06.01": None, "nonsense": None, "": None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "label string")
    now = F.expr("timestamp '2024-01-31 00:00:00'")
    assert {r["label"]: r["at"] for r in rows.select("label", F.date_format(list_time(F.col("label"), now), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()} == want


def test_answers_of_all_kinds(spark):
    """Cut answers and lists without patterns tell so, unknown adapters and empty answers give nothing."""
    from tidewell.sources.feeds import dispatched

    hits = '{"hits": [{"objectID": "7", "title": "a", "points": 3}, {"objectID": "8", "title": "b", "num_comments": 2}]}'
    rows = [
        (1, "s", "hn", hits), (2, "s", "hn", hits[:20]), (3, "s", "hn", None), (4, "s", "hn", '{"hits": []}'), (5, "s", "gopher", hits), (6, "l", "list", "<a href='/1'> x </a><a href='/2'> </a>"), (7, "m", "list", "<a href='/1'>x</a>"),
        (8, None, "list", ""), (9, "s", "rss", "<rss><item><title>t</title><link>http://x/1</link></item></rss>"), (10, "s", "rss", "nothing"), (11, "s", None, "x"),
    ]
    table = spark.createDataFrame(rows, "page_id long, source string, adapter string, body string")
    got = sorted((r["page_id"], r["place"] if r["place"] is not None else -1, r["title"] or "", r["comments"], r["problem"] or "") for r in dispatched(table, {"l": {"title": r"<a href='([^']+)'>([^<]*)</a>"}}).collect())
    assert got == [(1, 0, "a", 0, ""), (1, 1, "b", 2, ""), (2, -1, "", 0, "unreadable"), (3, -1, "", 0, "unreadable"), (6, 0, "x", 0, ""), (7, -1, "", 0, "no patterns"), (8, -1, "", 0, "no patterns"), (9, 0, "t", 0, "")]


def test_cosines_of_blocks_are_those_of_all_pairs(spark):
    """Readers in blocks of a few: weights that cancel out or are 0 are shared, readers without a category or a norm are left out."""
    import random

    rng = random.Random(3)
    rows = [(u, "tag", f"t{k}", rng.choice([-0.5, 0.0, 0.5, 1.25])) for u in range(60) for k in rng.sample(range(40), 6)]
    rows += [(u, "category", f"c{u % 3}", 0.5 if u % 2 else -0.5) for u in range(55)] + [(u, "style", "longform", 9.0) for u in range(60)]
    rows += [(70, "category", "c1", 0.0), (71, "category", "t1", 1.0)]
    table = spark.createDataFrame(rows, "user_id long, ns string, key string, weight double")
    own = {}
    for u, ns, key, w in rows:
        if ns != "style":
            own.setdefault(u, {})[ns, key] = w
    norm = {u: sum(w * w for w in x.values()) ** 0.5 for u, x in own.items() if any(ns == "category" for ns, _ in x)}
    want = {(a, b): round(sum(own[a][k] * own[b][k] for k in own[a] if k in own[b]) / (norm[a] * norm[b]), 9) for a in norm for b in norm if a < b and norm[a] and norm[b] and set(own[a]) & set(own[b])}
    got = [{(r["a"], r["b"]): round(r["sim"], 9) for r in U.cosines(table, size).collect()} for size in (None, 7)]
    assert got[0] == got[1] == want
    assert 0.0 in want.values() and 71 in norm and not any(71 in pair for pair in want)


def test_features_of_pairs_are_not_shuffled(spark):
    """Pairs and weights meet at their reader; only the reader is a key of an exchange, and odd rows count as a join would have them."""
    import re

    items = spark.createDataFrame([(1, "c1", None, ["a", "b"], 500), (2, None, "s", [], 50), (3, "c1", "s", ["a"], None)], "id long, category string, source string, tags array<string>, words int")
    prefs = spark.createDataFrame([(7, "category", "c1", 1.0), (7, "tag", "a", -0.5), (7, "style", "longform", 2.0), (None, "tag", "a", 9.0), (7, None, "a", 9.0), (7, "tag", None, 9.0)], "user_id long, ns string, key string, weight double")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (7, 9), (8, 3), (None, 1)], "user_id long, id long")
    scored = U.taste_scores(pairs, items, prefs)
    got = {(r["user_id"], r["id"]): (round(r["taste"], 9), r["known"]) for r in scored.collect()}
    assert got == {(7, 1): (1 - 0.325 + 0.8, 1.25), (7, 2): (-0.8, 0.0), (8, 3): (0.0, 0.0), (None, 1): (0.0, 0.0)}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(user_id#\d+L,? *\d*\)", plan) and not re.search(r"hashpartitioning\(user_id#\d+L, (ns|id)#", plan)


def test_survey_answers_are_summed_where_their_reader_is(spark):
    """Readers are spread before their answers are taken apart, so no task sums a whole file and no answer is shuffled."""
    plan = taste.survey_vector(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == plan.count("Exchange") == 1
    assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]


def test_steps_of_events_are_not_gathered(spark):
    """Events are shuffled whole to their reader and folded as they come; no list of a weight's steps is collected, and events of unknown items fade too."""
    items = spark.createDataFrame([(1, "c1", None, ["a"], 500), (2, "c1", "s", [], 200)], "id long, category string, source string, tags array<string>, words int")
    rows = [(7, 1, 2, 1.0), (7, 9, 3, 1.0), (7, 2, 4, 1.0), (7, 1, 1, -0.5), (7, 1, 5, 0.0), (8, 2, 1, 0.05), (None, 1, 1, 1.0)]
    learnt = U.learned_weights(spark.createDataFrame(rows, "user_id long, id long, ord long, step double"), items)
    got = {(r["user_id"], r["ns"], r["key"]): round(r["weight"], 9) for r in learnt.collect()}
    a, c = -0.5 * 0.995 + 1, -0.125 * 0.995 + 0.25
    assert got == {k: round(w, 9) for k, w in {
        (7, "tag", "a"): a * 0.995**2, (7, "category", "c1"): c * 0.995**2 + 0.25, (7, "source", "s"): 0.7, (7, "style", "longform"): 0.15, (8, "category", "c1"): 0.0125, (8, "source", "s"): 0.035,
    }.items()}
    plan = learnt._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "ns#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
