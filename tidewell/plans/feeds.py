"""Queries of feed and page parsing. Test feeds are written from the tables, so the SQL can tell what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.base import Catalogue
from tidewell.sources import feeds as S
from tidewell.sources.adapters import NOW, items, registry, table

CATALOGUE = Catalogue()
query = CATALOGUE.query

_PLAIN = "regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9 ]', '{1}')"
_SQL_PLAIN = "trim(regexp_replace(substring(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9 ]', '', 'g'), 1, {1}), ' +', ' ', 'g'), ' ')"


def _bare(column: str, most: int) -> str:
    return f"trim(regexp_replace(substring(regexp_replace(coalesce({column}, ''), '[^A-Za-z0-9 ]', ''), 1, {most}), ' +', ' '))"


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_url, xml): feeds of ten documents each, every third of Atom, every fourth of the news service."""
    item = f"""CASE WHEN doc_id div 10 % 3 = 0 THEN concat('<entry><title>', {_bare('text', 60)}, '</title><link href="http://x.example/', doc_id, '"/><summary>&lt;p&gt;', {_bare('text', 60)}, ' more &amp;amp; more&lt;/p&gt;</summary><updated>2024-01-0', doc_id % 9 + 1, 'T08:00:00Z</updated></entry>')
      ELSE concat('<item><title><![CDATA[', {_bare('text', 60)}, ']]></title><link>http://x.example/', doc_id, '</link><description>&lt;ol&gt;', repeat('&lt;li&gt;a&lt;/li&gt;', int(doc_id % 4)), '&lt;/ol&gt;note &amp;hellip; ', doc_id, '</description><pubDate>Tue, 0', doc_id % 9 + 1, ' Jan 2024 08:00:00 GMT</pubDate><slash:comments>', doc_id % 5, '</slash:comments>',
        CASE doc_id % 4 WHEN 0 THEN concat('<media:thumbnail url="//cdn.example/', doc_id, '.jpg"/>') WHEN 1 THEN concat('<enclosure type="audio/mp3" url="http://x/a.mp3"/><enclosure type="image/png" url="/p/', doc_id, '.png"/>')
          WHEN 2 THEN concat('<media:content type="video/mp4" url="http://x/v.mp4"/><media:content medium="audio" url="http://x/b.mp3"/><media:content medium="image" url="//m.example/', doc_id, '.jpg"/>') ELSE '' END, '</item>') END"""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 10 AS feed", f"{item} AS item")
    made = rows.groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "").alias("body"))
    url = "if(feed % 4 = 1, concat('https://news.google.com/rss/', feed), concat('http://feed.example/', feed))"
    return made.selectExpr(f"{url} AS feed_url", "if(feed % 3 = 0, concat('<feed><entry_list/>', body, '</feed>'), concat('<rss><channel><title>c</title>', body, '</channel></rss>')) AS xml")


@query(
    f"""WITH d AS (SELECT doc_id, doc_id // 10 AS feed, {_SQL_PLAIN.format('text', 60)} AS title FROM documents)
SELECT CASE WHEN feed % 4 = 1 THEN 'https://news.google.com/rss/' ELSE 'http://feed.example/' END || feed AS feed_url, title,
  CASE WHEN feed % 3 = 0 THEN 'more & more' ELSE repeat('a ', CAST(doc_id % 4 AS INTEGER)) || 'note … ' || doc_id END AS summary,
  'http://x.example/' || doc_id AS url, CASE WHEN feed % 3 > 0 AND doc_id % 5 > 0 THEN doc_id % 5 END AS comments,
  CASE WHEN feed % 3 > 0 THEN CASE doc_id % 4 WHEN 0 THEN 'http://cdn.example/' || doc_id || '.jpg' WHEN 1 THEN 'http://x.example/p/' || doc_id || '.png' WHEN 2 THEN 'http://m.example/' || doc_id || '.jpg' END END AS image,
  CASE WHEN feed % 3 > 0 AND feed % 4 = 1 THEN doc_id % 4 ELSE 0 END AS coverage, '2024-01-0' || (doc_id % 9 + 1) || ' 08:00' AS at
FROM d WHERE title <> ''"""
)
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.feed_items(feed_files(spark, sf_dir))
    at = F.date_format(S.feed_time(F.col("at"), F.expr(NOW)), "yyyy-MM-dd HH:mm")
    return rows.select("feed_url", "title", "summary", "url", "comments", "image", "coverage", at.alias("at"))


@query(
    """WITH p AS (SELECT page_id, html FROM pages)
SELECT page_id, (len(regexp_extract_all(html, '<li><a href="/[^"]+">[^<]+</a></li>'))) AS n FROM p WHERE regexp_matches(html, '<li><a href="/[^"]+">[^<]+</a></li>')"""
)
def listed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.listed_items(table(spark, sf_dir, "pages"), {"title": r'<li><a href="(/[^"]+)">([^<]+)</a></li>'}, 1 << 20)
    return rows.groupBy("page_id").agg(F.count("*").alias("n"))


_LINK = '<li><a href="(/[^"]+)">([^<]+)</a></li>'
#: Matches of a list page with the text after each, whose place follows from the lengths of all before it.
_LISTED = f"""p AS (SELECT page_id, html, regexp_extract_all(html, '{_LINK}') AS m, regexp_extract_all(html, '{_LINK}', 1) AS u, regexp_extract_all(html, '{_LINK}', 2) AS t, regexp_split_to_array(html, '{_LINK}') AS s FROM pages),
x AS (SELECT page_id, k, m[k] AS m, u[k] AS url, trim(t[k]) AS title, substring(html, CAST(list_sum(list_transform(s[1:k], lambda a: length(a))) + list_sum(list_transform(m[1:k], lambda a: length(a))) AS BIGINT) + 1, 200) AS after FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM p))"""


@query(
    f"""WITH {_LISTED}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS place FROM x WHERE NOT contains(m, 'href="/the') AND title <> '')
SELECT page_id, place, title, url, CAST(NULL AS VARCHAR) AS "at", CAST(nullif(regexp_extract(after, '<a href="/(\\d+)"', 1), '') AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS comments, CAST(NULL AS DOUBLE) AS views, CAST(NULL AS VARCHAR) AS thumb FROM r WHERE place < 60"""
)
def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of list pages with what stands around them."""
    config = {"title": r'<li><a href="(/[^"]+)">([^<]+)</a></li>', "exclude": r'href="/the', "score": r'<a href="/(\d+)"', "after": 200}
    return S.listed_items(table(spark, sf_dir, "pages"), config)


_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with descriptions of themselves put before their markup."""
    head = """CASE page_id % 5 WHEN 0 THEN concat('<meta property="og:title" content="T ', page_id, ' &amp; co"><meta content="a description of page ', page_id, '" name="description"><meta property="og:image" content="/i/', page_id, '.png">')
      WHEN 1 THEN concat('<meta name="twitter:image" content="https://x.example/banner/a.png"><img src="logo.png"><img width="90" src="/s.jpg"><img data-src="/big/', page_id, '.jpg" width="600">')
      WHEN 2 THEN '<meta name="description" content="short"><iframe src="https://www.youtube.com/embed/abcdefghijk">' ELSE '' END"""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"concat({head}, '<title>Page ', page_id, '</title>') AS html")


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'T ' || page_id || ' & co' ELSE 'Page ' || page_id END AS title,
  CASE page_id % 5 WHEN 0 THEN 'a description of page ' || page_id WHEN 2 THEN 'short' ELSE '' END AS summary,
  CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/i/' || page_id || '.png' WHEN 1 THEN 'https://x.example/banner/a.png' END AS image,
  coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', ''), '') AS site,
  CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/i/' || page_id || '.png' WHEN 1 THEN regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/big/' || page_id || '.jpg'
    WHEN 2 THEN 'https://img.youtube.com/vi/abcdefghijk/hqdefault.jpg' END AS picture,
  CASE WHEN page_id % 5 = 0 THEN 'a description of page ' || page_id END AS excerpt
FROM pages WHERE url LIKE 'http%://_%'"""
)
def open_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(spark, sf_dir).filter("url like 'http%://_%'")
    told = S.open_graph(F.col("html"), F.col("url"))
    return rows.select("page_id", *[c.alias(n) for n, c in told.items()], S.page_image(F.col("html"), F.col("url")).alias("picture"), S.page_excerpt(F.col("html")).alias("excerpt"))


@query(
    """WITH i AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'own' END AS image, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE '' END AS summary, page_id % 5 AS k FROM pages),
c AS (SELECT *, k = 1 OR k = 2 AS hit FROM i)
SELECT page_id, coalesce(image, CASE WHEN hit THEN 'cached' || page_id END) AS image, coalesce(nullif(summary, ''), CASE WHEN hit THEN 'told' END) AS summary, (image IS NULL OR summary = '') AND NOT hit AS to_fetch FROM c"""
)
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.selectExpr("page_id", "concat('u', page_id) AS url", "if(page_id % 3 = 0, 'own', null) AS image", "if(page_id % 2 = 0, 'text', '') AS summary")
    cache = pages.filter("page_id % 5 > 0").selectExpr("concat('u', page_id) AS url", "concat('cached', page_id) AS image", "'told' AS summary", f"{NOW} + make_dt_interval(0, if(page_id % 5 < 3, 1, -1)) AS expires_at")
    return S.enriched(rows, cache, F.expr(NOW)).select("page_id", "image", "summary", "to_fetch")


@query(
    """WITH r AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey <= 200)
SELECT p_partkey // 20 AS page, trim(p_name, ' ') AS name, 'https://twitter.com/search?q=' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN p_size || 'K' END AS "count" FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 20, trim(p_name, ' ') ORDER BY p_partkey) AS r FROM r) WHERE r = 1"""
)
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = "concat('<a href=\"https://twitter.com/search?q=', p_partkey, '\" class=trend-link>', p_name, '</a>', if(p_partkey % 2 = 0, concat('<span class=tweet-count data-count=\"1\">', p_size, 'K</span>'), ''))"
    rows = table(spark, sf_dir, "part").filter("p_partkey <= 200").selectExpr("p_partkey div 20 AS page", "p_partkey", f"{link} AS a")
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "a"))), lambda x: x["a"]), "\n").alias("html"))
    return pages.select("page", F.explode(S.trend_rows(F.col("html"))).alias("t")).select("page", "t.*")


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'term ' || p_size WHEN 1 THEN '재건축' ELSE 'a & b' END AS term, p_partkey * 1000 AS traffic, 'news of ' || p_partkey AS news FROM part WHERE p_partkey % 4 < 2"""
)
def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = """concat('<rss><item><title>', CASE p_partkey % 4 WHEN 0 THEN concat('term ', p_size) WHEN 1 THEN '<![CDATA[재건축]]>' WHEN 2 THEN 'x' ELSE 'odd $ sign' END, '</title><ht:approx_traffic>', format_number(p_partkey * 1000, 0), '+</ht:approx_traffic><ht:news_item_title><![CDATA[news of ', p_partkey, ']]></ht:news_item_title></item></rss>')"""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(S.interest_rows(F.expr(xml))).alias("t"))
    return rows.select("id", "t.term", "t.traffic", F.array_join("t.news", "|").alias("news"))


@query(
    """SELECT id, title, summary, url, CAST(score AS BIGINT) AS score, CAST(comments AS BIGINT) AS comments FROM (
SELECT 'hn_' || p_partkey AS id, p_name AS title, 'about ' || p_brand AS summary, CASE WHEN p_partkey % 2 = 0 THEN 'http://x/' || p_partkey ELSE 'https://news.ycombinator.com/item?id=' || p_partkey END AS url, p_size AS score, 0 AS comments FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'devto_' || p_partkey, p_name, 'about ' || p_brand, 'https://dev.to/p/' || p_partkey, p_size, 3 FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'rd_' || p_partkey, p_name, 'about ' || p_brand, 'https://reddit.com/r/' || p_partkey, p_size, 4 FROM part WHERE p_partkey % 3 = 2)"""
)
def interface_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    about = "concat('about &lt;b&gt;', p_brand, '&lt;/b&gt;')"
    hits = part.filter("p_partkey % 3 = 0").select(F.expr(f"to_json(named_struct('hits', array(named_struct('objectID', string(p_partkey), 'title', p_name, 'story_text', {about}, 'url', if(p_partkey % 2 = 0, concat('http://x/', p_partkey), ''), 'points', p_size))))").alias("b"))
    articles = part.filter("p_partkey % 3 = 1").select(F.expr(f"to_json(array(named_struct('id', p_partkey, 'title', p_name, 'description', {about}, 'path', concat('/p/', p_partkey), 'positive_reactions_count', p_size, 'comments_count', 3, 'user', named_struct('username', 'u'))))").alias("b"))
    boards = part.filter("p_partkey % 3 = 2").select(F.expr(f"to_json(named_struct('data', named_struct('children', array(named_struct('data', named_struct('id', string(p_partkey), 'title', p_name, 'selftext', {about}, 'permalink', concat('/r/', p_partkey), 'score', p_size, 'num_comments', 4, 'author', 'a'))))))").alias("b"))
    whole = hits.select(F.explode(S.hacker_rows(F.col("b"))).alias("i")).union(articles.select(F.explode(S.article_rows(F.col("b"))).alias("i"))).union(boards.select(F.explode(S.board_rows(F.col("b"))).alias("i")))
    return whole.select("i.id", "i.title", "i.summary", "i.url", "i.score", "i.comments")


@query("SELECT c_custkey, '고객 ' || c_name || ' 님' AS name FROM customer")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written in the Korean code page and read again."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def written(text):
        return text.map(lambda t: t.encode("cp949"))

    rows = table(spark, sf_dir, "customer").select("c_custkey", written(F.expr("concat('고객 ', c_name, ' 님')")).alias("raw"))
    return rows.select("c_custkey", S.decode_cp949("raw").alias("name"))


@query(
    """WITH r AS (SELECT id, source, ord, CASE WHEN id % 4 = 0 THEN 'Item ' || id || ' - Outlet ' || (id % 3) WHEN id % 7 = 0 THEN 'advert ' || id ELSE 'Item ' || id END AS title, CAST(substring(source, 4) AS INTEGER) AS no FROM items WHERE source IS NOT NULL),
f AS (SELECT * FROM r WHERE no % 7 <> 3 AND NOT (no % 2 = 0 AND starts_with(title, 'advert')))
SELECT id, CASE WHEN no < 3 THEN 'gnews' ELSE 'src' END || no AS source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS source_rank, CASE WHEN no < 3 AND contains(title, ' - ') THEN 'Outlet ' || (id % 3) END AS source_label,
  CASE WHEN no < 3 THEN split_part(title, ' - ', 1) ELSE title END AS title FROM f""",
    "items",
)
def built_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = "CASE WHEN id % 4 = 0 THEN concat('Item ', id, ' - Outlet ', id % 3) WHEN id % 7 = 0 THEN concat('advert ', id) ELSE concat('Item ', id) END"
    name = "concat(if(int(substring(source, 4)) < 3, 'gnews', 'src'), int(substring(source, 4)))"
    rows = items(spark, sf_dir).filter("source is not null").selectExpr("id", f"{name} AS source", "ord AS place", f"{title} AS title")
    known = registry(spark, sf_dir).selectExpr("concat(if(no < 3, 'gnews', 'src'), no) AS source", "enabled", "if(no % 2 = 0, '^advert', null) AS exclude").filter("source is not null")
    return S.built_rows(rows, known).select("id", "source", F.col("source_rank").cast("long").alias("source_rank"), "source_label", "title")


@query(
    """SELECT p_partkey AS id, p_name AS title, 'https://' || CASE WHEN p_partkey % 3 = 0 THEN 'shop' ELSE 'mall' END || '.example/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'https://i/' || p_partkey END AS image,
 CASE WHEN p_size % 5 = 0 THEN 'life' ELSE 'c' || (p_size % 5) END AS category, CASE p_partkey % 4 WHEN 1 THEN '2024-02-0' || (p_partkey % 9 + 1) || ' 14:59:59' WHEN 2 THEN '1970-01-01 00:00:00' END AS until
FROM part WHERE p_partkey % 5 > 0 AND p_size % 5 <> 4"""
)
def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = "concat(' https://', CASE WHEN p_partkey % 5 = 0 THEN 'evil' WHEN p_partkey % 3 = 0 THEN 'shop' ELSE 'mall' END, '.example/', p_partkey)"
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS title", f"{url} AS url", "concat(if(p_partkey % 2 = 0, 'https://i/', 'rel/'), p_partkey) AS image", "if(p_size % 5 = 0, '', concat('c', p_size % 5)) AS category",
        "CASE p_partkey % 4 WHEN 1 THEN concat('2024-02-0', p_partkey % 9 + 1) WHEN 2 THEN 'soon' END AS expires",
    )
    out = S.catalog_rows(rows, ["shop.example", "mall.example"], ["c4"])
    return out.withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss"))


@query(
    """SELECT 'all' AS what, '' AS key, count(*) AS n FROM registry UNION ALL SELECT 'enabled', '', count(*) FILTER (enabled) FROM registry UNION ALL SELECT 'adult', '', count(*) FILTER (adult) FROM registry
UNION ALL SELECT 'country', country, count(*) FROM registry GROUP BY country""",
    "registry",
)
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.registry_summary(registry(spark, sf_dir))


@query("SELECT source, enabled, country FROM registry WHERE enabled AND NOT adult AND country = 'us'", "registry")
def registry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.registry_query(registry(spark, sf_dir), enabled=True, adult=False, country="us", feed_group=None).select("source", "enabled", "country")


@query(
    f"""WITH {_LISTED}, k AS (SELECT page_id, 'src' || (page_id % 5) AS source, ['hn', 'json', 'reddit', 'rss', 'list', 'gopher'][page_id % 6 + 1] AS adapter, page_id % 7 = 0 AS bad FROM pages),
l AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS place, title, url FROM x WHERE title <> '')
SELECT page_id, source, adapter, 0 AS place, 'T' || page_id AS title, CASE adapter WHEN 'hn' THEN 'https://news.ycombinator.com/item?id=' || page_id WHEN 'json' THEN 'https://dev.to/p/' || page_id WHEN 'reddit' THEN 'https://reddit.com/r/' || page_id ELSE 'http://x.example/' || page_id END AS url,
  CASE WHEN adapter = 'rss' THEN 0 ELSE page_id % 50 END AS score, CASE adapter WHEN 'hn' THEN 0 WHEN 'rss' THEN page_id % 9 ELSE 3 END AS comments, NULL AS problem FROM k WHERE adapter IN ('hn', 'json', 'reddit', 'rss') AND NOT (bad AND adapter <> 'rss')
UNION ALL SELECT page_id, source, adapter, NULL, NULL, NULL, 0, 0, 'unreadable' FROM k WHERE bad AND adapter IN ('hn', 'json', 'reddit')
UNION ALL SELECT page_id, source, adapter, NULL, NULL, NULL, 0, 0, 'no patterns' FROM k WHERE adapter = 'list' AND source = 'src1'
UNION ALL SELECT page_id, source, adapter, place, title, url, 0, 0, NULL FROM l JOIN k USING (page_id) WHERE adapter = 'list' AND source <> 'src1' AND place < 60"""
)
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved answers of all kinds, one in seven of them cut short, each by its source's adapter."""
    name = "string(page_id)"
    body = f"""CASE page_id % 6
      WHEN 0 THEN to_json(named_struct('hits', array(named_struct('objectID', {name}, 'title', concat('T', page_id), 'points', page_id % 50))))
      WHEN 1 THEN to_json(array(named_struct('id', page_id, 'title', concat('T', page_id), 'path', concat('/p/', page_id), 'positive_reactions_count', page_id % 50, 'comments_count', 3)))
      WHEN 2 THEN to_json(named_struct('data', named_struct('children', array(named_struct('data', named_struct('id', {name}, 'title', concat('T', page_id), 'permalink', concat('/r/', page_id), 'score', page_id % 50, 'num_comments', 3))))))
      WHEN 3 THEN concat('<rss><item><title>T', page_id, '</title><link>http://x.example/', page_id, '</link><slash:comments>', page_id % 9, '</slash:comments></item></rss>') ELSE html END"""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "concat('src', page_id % 5) AS source", "array('hn', 'json', 'reddit', 'rss', 'list', 'gopher')[page_id % 6] AS adapter", f"{body} AS body")
    rows = rows.withColumn("body", F.when((F.col("page_id") % 7 == 0) & (F.col("page_id") % 6 < 3), F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body")))
    return S.dispatched(rows, {f"src{i}": {"title": _LINK} for i in (0, 2, 3, 4)})
