"""Rows from feeds, pages and interfaces: markup in a column becomes items by expressions; nothing is fetched here."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions.text import decode_entities, number_of, strip_html, url_host
from tidewell.operators.gates import junk_image

#: Related articles that the news service tells of at most.
COVERAGE_MAX = 5
EXCERPT = 200


def xml_text(block: Column, name: str) -> Column:
    """Text of an element, out of CDATA and entities; of one without text its link; '' where absent."""
    found = F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
    told = F.trim(decode_entities(F.regexp_replace(found, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))
    link = F.trim(F.regexp_extract(block, rf"(?is)<{name}[^>]*\bhref=[\"']([^\"']+)[\"']", 1))
    return F.when(block.rlike(rf"(?is)<{name}[^>]*>.*?</{name}>"), told).otherwise(link)


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}=[\"']([^\"']+)[\"']", 1), F.lit(""))


def absolute(url: Column, base: Column) -> Column:
    """A url as its page has it: whole ones as they are, others by the page's scheme, host or folder; null for none."""
    origin, scheme = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"(?i)^(https?:)", 1)
    folder = F.regexp_extract(base, r"(?i)^(https?://[^?#]*/)[^/?#]*", 1)
    return (
        F.when(F.trim(url) == "", None)
        .when(url.rlike("(?i)^[a-z][a-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, url))
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/"))), url))
    )


def feed_image(block: Column, description: Column, content: Column, base: Column) -> Column:
    """The picture of a feed item: its thumbnail, its media or enclosure of an image type, or the first in its texts."""
    def tags(name: str) -> Column:
        return F.regexp_extract_all(block, F.lit(rf"(?i)<{name}\b[^>]*>"), 0)

    def first(found: Column) -> Column:
        return F.get(F.filter(found, lambda u: u.isNotNull()), F.lit(0))

    thumb = first(F.transform(tags("media:thumbnail"), lambda t: _attribute(t, "url")))
    kind, medium = (lambda t: _attribute(t, "type")), (lambda t: _attribute(t, "medium"))
    fit = lambda t: F.when(kind(t).isNotNull(), kind(t).rlike("(?i)^image/")).otherwise(F.coalesce(medium(t).rlike("(?i)^image$"), F.lit(True)))
    media = first(F.transform(tags("media:content"), lambda t: F.when(fit(t), _attribute(t, "url"))))
    enclosed = first(F.transform(tags("enclosure"), lambda t: F.when(F.coalesce(kind(t).rlike("(?i)^image/"), F.lit(False)), _attribute(t, "url"))))
    drawn = [F.nullif(F.trim(F.regexp_extract(h, r"(?i)<img\b[^>]*\bsrc=[\"']([^\"']+)[\"']", 1)), F.lit("")) for h in (description, content)]
    return absolute(F.coalesce(*[F.trim(decode_entities(x)) for x in (thumb, media, enclosed)], *drawn), base)


def related_count(description: Column, feed_url: Column) -> Column:
    """List items of a description that the news service bundles; 0 from elsewhere."""
    bundled = F.coalesce(feed_url.cast("string").rlike("(?i)news\\.google\\.com"), F.lit(False)) | description.rlike("(?i)news\\.google\\.com")
    return F.when(bundled, F.regexp_count(description, F.lit(r"(?i)&lt;li&gt;|<li[\s>]"))).otherwise(0)


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_url, place, title, summary, url, published, comments, image, coverage) of feeds (feed_url, xml).

    Entries of Atom, else items of RSS; those without title go. A summary that
    begins with the title goes on after it; one of the news service is left out.
    """
    atom = F.col("xml").rlike(r"(?i)<feed[\s>]") & F.col("xml").rlike(r"(?i)<entry[\s>]")
    blocks = F.when(atom, F.regexp_extract_all("xml", F.lit(r"(?is)<entry[\s>].*?</entry>"), 0)).otherwise(F.regexp_extract_all("xml", F.lit(r"(?is)<item[\s>].*?</item>"), 0))
    rows = feeds.select("feed_url", atom.alias("atom"), F.posexplode(blocks).alias("place", "b"))
    b = F.col("b")

    def either(one: str, two: str) -> Column:
        return F.coalesce(F.nullif(xml_text(b, one), F.lit("")), xml_text(b, two))

    rows = rows.withColumns(
        {
            "title": xml_text(b, "title"),
            "d": F.when(F.col("atom"), either("summary", "content")).otherwise(xml_text(b, "description")),
            "c": F.when(F.col("atom"), "").otherwise(xml_text(b, "content:encoded")),
            "url": either("link", "guid"),
            "at": F.coalesce(F.nullif(F.when(F.col("atom"), xml_text(b, "updated")).otherwise(xml_text(b, "pubDate")), F.lit("")), xml_text(b, "dc:date")),
        }
    ).filter("title != ''")
    bare = strip_html(F.col("d"))
    summary = F.when(F.col("d").rlike("(?i)news\\.google\\.com"), "").when(bare.startswith(F.col("title")), F.trim(F.expr("substring(s, length(title) + 1)"))).otherwise(bare)
    comments = F.try_to_number(F.nullif(xml_text(b, "slash:comments"), F.lit("")), F.lit("999999999")).cast("long")
    origin = F.regexp_extract("url", "(?i)^(https?://[^/]+)", 1)
    return rows.withColumn("s", bare).select(
        "feed_url", "place", "title", summary.alias("summary"), "url", "at", F.when(comments > 0, comments).alias("comments"),
        feed_image(b, F.col("d"), F.col("c"), origin).alias("image"), related_count(F.col("d"), F.col("feed_url")).cast("long").alias("coverage"),
    )


def feed_time(at: Column, now: Column) -> Column:
    """A feed's time, in its mail or ISO form; null if it can't be read or isn't sane."""
    from tidewell.functions.dates import sane_time

    mail = F.regexp_replace(F.regexp_replace(at, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    read = F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(at))
    return sane_time(read, now)


def listed_items(pages: DataFrame, config: dict, most: int = 60) -> DataFrame:
    """(page_id, place, title, url, at, score, comments, views, thumb) that a list page's patterns find, from pages (page_id, html).

    ``config`` holds ``title`` with groups for url and title, and patterns for what
    stands within ``before`` and ``after`` characters of it. Patterns are data and
    need the text around each match, which no column expression gives.
    """
    title = re.compile(config["title"], re.S)
    out = re.compile(config["exclude"], re.S) if config.get("exclude") else None
    near = {k: re.compile(config[k], re.S) for k in ("at", "score", "comments", "views", "thumb") if config.get(k)}
    before, after, sides = config.get("before", 0), config.get("after", 400), config.get("sides", {})

    def number(found: str | None) -> float | None:
        bare = re.sub(r"[,\s]", "", found or "")
        return (float(bare) if re.fullmatch(r"\d+(\.\d+)?", bare) else 0.0) if found is not None else None

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                place = 0
                for m in title.finditer(html or ""):
                    url, name = m.group(config.get("url_group", 1)), (m.group(config.get("title_group", 2)) or "").strip()
                    around = {"before": html[max(0, m.start() - before) : m.start()], "after": html[m.end() : m.end() + after]}
                    if not url or not name or (out and out.search(around["before"] + m.group(0))):
                        continue
                    found = {k: p.search(around[sides.get(k, "after")]) for k, p in near.items()}
                    told = {k: f.group(1) if f else None for k, f in found.items()}
                    rows.append((page, place, name, url, told.get("at"), *(number(told.get(k)) for k in ("score", "comments", "views")), told.get("thumb")))
                    place += 1
                    if place >= most:
                        break
            yield pd.DataFrame(rows, columns=["page_id", "place", "title", "url", "at", "score", "comments", "views", "thumb"])

    schema = "page_id long, place long, title string, url string, at string, score double, comments double, views double, thumb string"
    found = pages.select("page_id", "html").mapInPandas(work, schema)
    return found.withColumns({"title": decode_entities(F.col("title")), "url": decode_entities(F.col("url"))})


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name, attributes in either order; null where there is none."""
    one = rf"(?is)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']"
    two = rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{name}[\"']"
    return F.when(html.rlike(one), F.regexp_extract(html, one, 1)).when(html.rlike(two), F.regexp_extract(html, two, 1))


def open_graph(html: Column, url: Column) -> dict[str, Column]:
    """title, summary, image and site of a page by its own description of itself."""
    def told(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(decode_entities(meta(html, n))), F.lit("")) for n in names], F.lit(""))

    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return {
        "title": F.substring(F.coalesce(F.nullif(told("og:title", "twitter:title"), F.lit("")), F.trim(decode_entities(title))), 1, 300),
        "summary": F.substring(told("og:description", "twitter:description", "description"), 1, EXCERPT),
        "image": absolute(told("og:image", "twitter:image"), url),
        "site": F.coalesce(F.nullif(told("og:site_name"), F.lit("")), F.regexp_replace(url_host(url), r"^www\.", ""), F.lit("")),
    }


def page_image(html: Column, url: Column) -> Column:
    """A page's picture: what it names, a video's thumbnail, or the first of its text that is no ornament; null if all are junk."""
    named = [F.trim(decode_entities(meta(html, n))) for n in ("og:image", "og:image:secure_url", "twitter:image", "twitter:image:src")]
    video = F.nullif(F.regexp_extract(html, r"(?i)(?:youtube\.com/(?:embed/|watch\?v=)|youtu\.be/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
    thumb = F.concat(F.lit("https://img.youtube.com/vi/"), video, F.lit("/hqdefault.jpg"))

    def drawn(tag: Column) -> Column:
        src = F.coalesce(_attribute(tag, "src"), _attribute(tag, "data-src"))
        sides = [F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?i)\b{s}=[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(0)) for s in ("width", "height")]
        small = ((sides[0] > 0) & (sides[0] < 150)) | ((sides[1] > 0) & (sides[1] < 150))
        # fixed values
        ornament = src.startswith("data:") | src.rlike("(?i)(logo|icon|sprite|avatar|profile|blank|spacer|pixel|1x1|banner_|btn_|emoticon)")
        return F.when(~small & ~ornament, F.trim(decode_entities(src)))

    own = F.get(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), 0), drawn), lambda u: u.isNotNull() & (u != "")), F.lit(0))
    whole = F.transform(F.array(*named, thumb, own), lambda u: absolute(u, url))
    return F.get(F.filter(whole, lambda u: u.isNotNull() & u.rlike("(?i)^https?://") & ~junk_image(u)), F.lit(0))


def page_excerpt(html: Column) -> Column:
    """A page's description of 15 characters at least, cut at 200 with an ellipsis; null without one."""
    told = [F.trim(F.regexp_replace(decode_entities(meta(html, n)), r"\s+", " ")) for n in ("og:description", "twitter:description", "description")]
    fit = F.coalesce(*[F.when(F.length(t) >= 15, t) for t in told])
    return F.when(F.length(fit) > EXCERPT, F.concat(F.rtrim(F.substring(fit, 1, EXCERPT - 1)), F.lit("…"))).otherwise(fit)


def enriched(items: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``items`` (url, image, summary) with what an unexpired cache row (url, image, summary, expires_at) adds, and whether the url is still to be looked up."""
    live = cache.filter(F.col("expires_at") > now).select("url", F.col("image").alias("__i"), F.col("summary").alias("__s"), F.lit(True).alias("__hit"))
    met = items.join(live, "url", "left")
    lacks = F.col("image").isNull() | (F.coalesce("summary", F.lit("")) == "")
    out = {"image": F.coalesce("image", "__i"), "summary": F.coalesce(F.nullif("summary", F.lit("")), "__s"), "to_fetch": lacks & F.col("__hit").isNull()}
    return met.withColumns(out).drop("__i", "__s", "__hit")


def trend_rows(html: Column) -> Column:
    """array<struct<name, url, count>> of a trends page, each name where it stands first."""
    link = r"<a href=\"(https://twitter\.com/search\?q=[^\"]+)\"[^>]*class=[\"']?trend-link[\"']?[^>]*>([^<]+)</a>(?:<span[^>]*class=[\"']?tweet-count[^>]*>([^<]*)</span>)?"
    names, urls, counts = (F.regexp_extract_all(html, F.lit(link), i) for i in (2, 1, 3))
    rows = F.transform(F.arrays_zip(names.alias("n"), urls.alias("u"), counts.alias("c")), lambda x: F.struct(F.trim(x["n"]).alias("name"), x["u"].alias("url"), F.nullif(F.trim(x["c"]), F.lit("")).alias("count")))
    seen = F.transform(rows, lambda x: x["name"])
    return F.filter(rows, lambda x, i: (x["name"] != "") & (F.array_position(seen, x["name"]) == i + 1))


def useful_term(term: Column) -> Column:
    t = F.trim(term)
    # fixed values
    return F.length(t).between(2, 40) & ~t.rlike(r"[^가-힣ㄱ-ㆎa-zA-Z0-9·\-.&'’\s]")


def interest_rows(xml: Column) -> Column:
    """array<struct<term, traffic, news>> of a feed of searched terms; those of odd length or signs go."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<item\b.*?</item>"), 0)

    def inner(b: Column, name: str) -> Column:
        return F.trim(decode_entities(F.regexp_extract(b, rf"(?s)<{name}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>", 1)))

    def of(b: Column) -> Column:
        news = F.regexp_extract_all(b, F.lit(r"(?s)<ht:news_item_title>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</ht:news_item_title>"), 1)
        told = F.filter(F.transform(news, lambda n: F.trim(decode_entities(n))), lambda n: n != "")
        return F.struct(inner(b, "title").alias("term"), number_of(inner(b, "ht:approx_traffic")).alias("traffic"), told.alias("news"))

    return F.filter(F.transform(blocks, of), lambda r: (r["term"] != "") & useful_term(r["term"]))


def hacker_rows(body: Column) -> Column:
    """Items of a search interface's answer, {hits: [...]}."""
    hits = F.from_json(body, "hits array<struct<objectID string, title string, story_text string, url string, points long, num_comments long, author string, created_at string>>")["hits"]
    return F.transform(
        hits,
        lambda h: _item(
            F.concat(F.lit("hn_"), h["objectID"]), h["title"], strip_html(h["story_text"]),
            F.coalesce(F.nullif(h["url"], F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), h["objectID"])), h["points"], h["num_comments"], h["author"],
        ),
    )


def article_rows(body: Column) -> Column:
    """Items of an article interface's answer, an array."""
    rows = F.from_json(body, "array<struct<id string, title string, description string, url string, path string, positive_reactions_count long, comments_count long, user struct<username string>>>")
    return F.transform(
        rows,
        lambda a: _item(
            F.concat(F.lit("devto_"), a["id"]), a["title"], strip_html(a["description"]), F.coalesce(F.nullif(a["url"], F.lit("")), F.concat(F.lit("https://dev.to"), a["path"])),
            a["positive_reactions_count"], a["comments_count"], a["user"]["username"],
        ),
    )


def board_rows(body: Column) -> Column:
    """Items of a board's answer, {data: {children: [{data}]}}."""
    kids = F.from_json(body, "data struct<children array<struct<data struct<id string, title string, selftext string, url_overridden_by_dest string, permalink string, score long, num_comments long, author string>>>>")["data"]["children"]
    return F.transform(
        F.transform(kids, lambda c: c["data"]),
        lambda d: _item(
            F.concat(F.lit("rd_"), d["id"]), d["title"], F.substring(strip_html(d["selftext"]), 1, 800),
            F.coalesce(F.nullif(d["url_overridden_by_dest"], F.lit("")), F.concat(F.lit("https://reddit.com"), d["permalink"])), d["score"], d["num_comments"], d["author"],
        ),
    )


def _item(id_: Column, title: Column, summary: Column, url: Column, score: Column, comments: Column, author: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(
        id_.alias("id"), title.alias("title"), F.coalesce(summary, F.lit("")).alias("summary"), url.alias("url"), F.coalesce(score, zero).alias("score"),
        F.coalesce(comments, zero).alias("comments"), author.alias("author"),
    )


#: Interfaces whose answers one expression reads, by the adapter that a source names.
INTERFACES = {"hn": hacker_rows, "json": article_rows, "reddit": board_rows}


def dispatched(bodies: DataFrame, lists: dict[str, dict]) -> DataFrame:
    """(page_id, source, adapter, place, title, url, score, comments, problem) of saved answers (page_id, source, adapter, body).

    Each is read by its source's adapter: ``rss``, ``list`` with the source's
    patterns of ``lists`` ('' for those without), or one of INTERFACES. An answer
    that an interface can't read and a list without patterns give one row that
    tells so, an adapter that nobody knows gives none, and neither stops the others.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def rows(df: DataFrame, title: str, url: str, score: Column = zero, comments: Column = zero) -> DataFrame:
        return df.select("page_id", "source", "adapter", F.col("place").cast("long").alias("place"), F.col(title).alias("title"), F.col(url).alias("url"), score.cast("long").alias("score"), F.coalesce(comments.cast("long"), zero).alias("comments"), none.alias("problem"))

    def failed(df: DataFrame, why: str) -> DataFrame:
        return df.select("page_id", "source", "adapter", F.lit(None).cast("long").alias("place"), none.alias("title"), none.alias("url"), zero.alias("score"), zero.alias("comments"), F.lit(why).alias("problem"))

    read = F.when(F.lit(False), hacker_rows(F.col("body")))
    for name, reader in INTERFACES.items():
        read = read.when(F.col("adapter") == name, reader(F.col("body")))
    answers = bodies.filter(F.col("adapter").isin(*INTERFACES)).withColumn("items", read)
    met = answers.select("page_id", "source", "adapter", F.posexplode("items").alias("place", "i"))
    out = rows(met, "i.title", "i.url", F.col("i.score"), F.col("i.comments")).unionByName(failed(answers.filter("items is null"), "unreadable"))
    keys = bodies.select("page_id", "source", "adapter")
    feeds = feed_items(bodies.filter("adapter = 'rss'").select(F.col("page_id").alias("feed_url"), F.col("body").alias("xml")))
    out = out.unionByName(rows(feeds.withColumnRenamed("feed_url", "page_id").join(keys, "page_id"), "title", "url", zero, F.col("comments")))
    pages = bodies.filter("adapter = 'list'")
    for source, config in lists.items():
        own = pages.filter(F.col("source") == source) if source else pages.filter(~F.coalesce("source", F.lit("")).isin(*[s for s in lists if s]))
        found = listed_items(own.select("page_id", F.col("body").alias("html")), config).join(keys, "page_id")
        out = out.unionByName(rows(found, "title", "url", F.coalesce("score", F.lit(0.0)), F.col("comments")))
    if "" not in lists:
        out = out.unionByName(failed(pages.filter(~F.coalesce("source", F.lit("")).isin(*lists)), "no patterns"))
    return out


@F.pandas_udf(StringType())
def decode_cp949(raw: pd.Series) -> pd.Series:
    """Text of bytes in the extended Korean code page, which SQL's decode doesn't know; bad bytes as replacement characters."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("cp949", "replace"))


def built_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Collected ``rows`` (source, place, title) of enabled sources, shaped by their registry row: excluded titles out, then numbered, an outlet's name taken off a news title."""
    met = rows.join(F.broadcast(registry), "source").filter("enabled")
    met = met.filter(F.col("exclude").isNull() | ~F.regexp_like("title", F.coalesce("exclude", F.lit("$^"))))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("place")) - 1
    outlet = F.nullif(F.regexp_extract("title", r"\s+-\s+([^-]{1,30})$", 1), F.lit(""))
    bundle = F.col("source").startswith("gnews") & outlet.isNotNull()
    label = F.when(bundle, F.trim(outlet))
    title = F.when(bundle, F.trim(F.regexp_replace("title", r"\s+-\s+([^-]{1,30})$", ""))).otherwise(F.col("title"))
    return met.withColumns({"source_rank": rank, "source_label": label}).withColumn("title", title).drop("exclude")


def catalog_rows(products: DataFrame, hosts: list[str], banned: list[str]) -> DataFrame:
    """Products (id, title, url, image, category, expires) of allowed hosts and categories, with the last second of their day of expiry: null for never, 1970 for one that can't be read."""
    last = F.try_to_timestamp(F.concat(F.trim("expires"), F.lit(" 23:59:59+09:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    until = F.when(F.trim(F.coalesce("expires", F.lit(""))) == "", None).otherwise(F.coalesce(last, F.timestamp_seconds(F.lit(0))))
    fit = F.regexp_extract(F.trim("url"), "^https://([^/]+)/", 1).isin(hosts) & ~F.coalesce(F.col("category").isin(banned), F.lit(False)) & F.col("title").isNotNull()
    image = F.when(F.col("image").rlike("^https?://"), F.col("image"))
    return products.filter(fit).select("id", F.trim("title").alias("title"), F.trim("url").alias("url"), image.alias("image"), F.coalesce(F.nullif("category", F.lit("")), F.lit("life")).alias("category"), until.alias("until"))


def registry_summary(registry: DataFrame) -> DataFrame:
    """(what, key, n): sources in all, enabled, adult, and by country and language."""
    pairs = F.array(
        F.struct(F.lit("all").alias("what"), F.lit("").alias("key")), F.struct(F.when(F.col("enabled"), "enabled").alias("what"), F.lit("").alias("key")),
        F.struct(F.when(F.col("adult"), "adult").alias("what"), F.lit("").alias("key")), F.struct(F.lit("country").alias("what"), F.col("country").alias("key")),
    )
    return registry.select(F.explode(pairs).alias("p")).filter("p.what is not null").groupBy("p.what", "p.key").agg(F.count("*").alias("n"))


def registry_query(registry: DataFrame, **wanted) -> DataFrame:
    """Rows of a registry whose columns have the values ``wanted``; None is no constraint, and a row without a value meets none."""
    for column, value in wanted.items():
        if value is not None:
            registry = registry.filter(F.col(column) == F.lit(value))
    return registry
