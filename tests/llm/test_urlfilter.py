import random

from tidewell.llm import urlfilter


def _plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].lower(), rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def _urls():
    rng = random.Random(3)
    hosts = ["net", "a.net", "example.net", "x.example.net", "EXAMPLE.com", "notexample.com", "b.org", "org", "c.info", ""]
    paths = ["", "/", "/en/", "/en", "/de/x?y=/fr/", "/fr/#a", "?q=1", "#z", "/de/" + "x" * 5000, "/EN/", "/fr/fr/"]
    urls = [f"{s}://{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http", "https", "x") for _ in range(150)]
    return [*urls, None, "", "no scheme", "://", "a\nb://net/\nx", "http://a://net/"]


def test_verdicts_in_one_part_and_in_several(spark):
    urls = list(enumerate(_urls()))
    pages = spark.createDataFrame([(i, u, "old") for i, u in urls], "page_id long, url string, rule string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    for limit in (urlfilter.MAX_FILTER_BYTES, 4):
        out = urlfilter.judge_urls(pages, rules, limit=limit)
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
        assert got == {i: _plain(u, urlfilter.RULES) for i, u in urls}


def test_no_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    assert urlfilter.judge_urls(pages, rules.limit(0)).first()["verdict"] == "allow"
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_many_rules(spark):
    rng = random.Random(4)
    rules = sorted({(f"h{rng.randrange(300)}.com", f"/{rng.randrange(3)}"): rng.choice(("block", "allow")) for _ in range(500)}.items())
    rules = [(*k, v) for k, v in rules]
    urls = list(enumerate(f"http://s.h{rng.randrange(400)}.com/{rng.randrange(5)}" for _ in range(2000)))
    out = urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == {i: _plain(u, rules)[2:] for i, u in urls}
