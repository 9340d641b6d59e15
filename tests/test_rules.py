"""Rules with settings, lists and words, on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import gates as G
from tidewell.operators import hot, publish
from tidewell.sources.feeds import registry_query


def test_caps_by_precedence(spark):
    rows = spark.createDataFrame([("news",), ("community",), (None,)], "kind string")

    def caps(**settings):
        return [r["c"] for r in rows.select(hot.resolved_cap(F.col("kind"), **settings).alias("c")).collect()]

    assert caps() == [20, 100, 100]
    assert caps(shared=5) == [5, 5, 5]
    assert caps(shared=5, set_by_kind={"news": 3}) == [3, 5, 5]
    assert caps(set_by_kind={"news": 3, "community": 4}, by_kind={"community": 0}) == [3, 0, 0]
    assert caps(everywhere=7, by_kind={"news": 1}) == [7, 7, 7]


def test_capped_sources(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, s, at - dt.timedelta(hours=i), i) for s in ("a", "me", None) for i in range(4)]
    table = spark.createDataFrame(rows, "id long, source string, published_at timestamp, ord long")
    got = sorted((str(r["source"]), r["id"]) for r in hot.per_source(table, F.lit(2)).collect())
    assert got == [("None", 0), ("None", 1), ("a", 0), ("a", 1), ("me", 0), ("me", 1), ("me", 2), ("me", 3)]
    assert hot.per_source(table, F.lit(0)).count() == 12


def test_summaries_that_are_a_pages_own(spark):
    site, own = "words of a site that stand on every page", "what this very page alone has to say"
    rows = [(1, site), (2, f" {site}"), (3, own), (4, "too short"), (5, None), (6, "클릭하여 더 많은 내용을 보시기 바랍니다 여러분"), (7, own + "x" * 300), (8, "")]
    out = {r["id"]: r["summary"] for r in publish.own_summaries(spark.createDataFrame(rows, "id long, summary string")).collect()}
    assert out == {1: "", 2: "", 3: own, 4: "", 5: "", 6: "", 7: (own + "x" * 300)[:200], 8: ""}


def test_registry_queries(spark):
    rows = spark.createDataFrame([("a", True, "kr"), ("b", False, "kr"), ("c", True, None)], "source string, enabled boolean, country string")
    names = lambda **w: sorted(r["source"] for r in registry_query(rows, **w).collect())
    assert names() == names(enabled=None) == ["a", "b", "c"]
    assert names(enabled=False) == ["b"] and names(enabled=True, country="kr") == ["a"] and names(country="us") == []


def test_advert_copy(spark):
    rows = [("조용한 아침의 좋은 물건", True), ("오늘만 싸게 드립니다", False), ("이거 진짜 좋네요 여러분", False), ("삼만 원의 행복 30", False), ("짧다", False), ("굵은 <b>글씨</b> 좋아요", False), (None, False)]
    got = [r["s"] for r in spark.createDataFrame(rows, "t string, want boolean").select(G.sound_copy(F.col("t"), 6, 30).alias("s")).collect()]
    assert got == [w for _, w in rows]
    card = spark.createDataFrame([("조용한 아침의 물건", "날마다 조금씩 나아지는 살림", "보러 가기"), ("조용한 아침의 물건", "짧은 줄", "보러 가기")], "h string, l string, c string")
    assert [r["s"] for r in card.select(G.sound_card(F.col("h"), F.col("l"), F.col("c")).alias("s")).collect()] == [True, False]
    claims = [("업계 1위 상품", True), ("300명이 구매", True), ("후기 4.8점", True), ("12% 줄어드는", True), ("100% 만족", True), ("조용한 물건", False), (None, False)]
    assert [r["s"] for r in spark.createDataFrame(claims, "t string, w boolean").select(G.banned_claim(F.col("t")).alias("s")).collect()] == [w for _, w in claims]
