"""Filters and joins that decide which items a reader may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.hot import hours_between


def with_registry(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items with the columns of their source; the planner broadcasts the registry while it is small."""
    return items.join(registry, "source", "left")


def fresh_only(items: DataFrame, registry: DataFrame, now: Column, news: int = 24, other: int = 48) -> DataFrame:
    """Items not older than their cap, with the columns of their source.

    The cap is the kind's, or the source's where that is shorter, or longer and the
    item has any reaction or coverage. Caps of 0 and less let all pass, unknown
    ages too.
    """
    rows = with_registry(items, registry)
    usual = F.when(F.col("kind") == "news", news).otherwise(other)
    signal = F.coalesce("score", F.lit(0)) + F.coalesce("comment_count", F.lit(0)) + F.coalesce("coverage", F.lit(0))
    cap = F.when((F.col("max_age_h") <= usual) | (F.col("max_age_h").isNotNull() & (signal > 0)), F.col("max_age_h")).otherwise(usual)
    age = hours_between(now, F.col("published_at"))
    return rows.filter((cap <= 0) | F.coalesce(age <= cap, F.lit(True)))


def feed_gate(pairs: DataFrame, items: DataFrame, registry: DataFrame, muted: DataFrame, blocked: DataFrame, now: Column) -> DataFrame:
    """``pairs`` (user_id, id) of items a reader may see in the main feed.

    Out are items too old, of sources that are disabled or off the main feed, with a
    topic that is hidden unless the reader shows it (``blocked``: user_id, topic),
    and of sources the reader muted (``muted``: user_id, source).
    """
    fresh = fresh_only(items, registry, now).filter("enabled and not off_main").select("id", "source", "topics")
    rows = pairs.join(fresh, "id").join(muted, ["user_id", "source"], "left_anti")
    told = rows.select("user_id", "id", F.explode("topics").alias("topic")).join(blocked, ["user_id", "topic"], "left_semi")
    return rows.join(told.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti").select("user_id", "id")


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs of reader and item that were never shown; ``seen`` has the same keys."""
    return items.join(seen, ["user_id", "item_id"], "left_anti")


def topics_allowed(items: DataFrame, topics: str, shown: list[str], hidden: list[str]) -> DataFrame:
    """Items without a topic that is hidden unless the reader asked for it."""
    blocked = [t for t in hidden if t not in shown]
    return items.filter(~F.arrays_overlap(topics, F.array(*map(F.lit, blocked)))) if blocked else items


def upsert_pool(pool: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Pool after a tick: fresh values win, first sight and what fresh rows lack stay from the pool."""
    a, b = pool.alias("a"), fresh.alias("b")
    columns = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    for c in fresh.columns:
        if c not in (key, "first_seen"):
            columns.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
    columns.append(F.coalesce("a.first_seen", "b.first_seen").alias("first_seen"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def routed(work: DataFrame) -> DataFrame:
    """Work items with the queue they go to next and why."""
    # fixed values
    verbs = ["publish", "delete", "pay", "buy", "purchase", "refund", "send customer", "account change"]
    needs = (
        F.coalesce("requires_approval", F.lit(False))
        | F.coalesce(F.lower("risk").isin("high", "critical"), F.lit(False))
        | F.coalesce(F.lower("title").rlike("|".join(verbs)), F.lit(False))
    )
    ready = F.col("status") == "ready"
    queue = F.when(needs, "decision_queue").when(~ready | F.col("status").isNull(), "backlog").otherwise(F.concat(F.coalesce(F.nullif("target", F.lit("")), F.lit("general")), F.lit("_dispatch")))
    reason = F.when(needs, "human_approval_required").when(~ready | F.col("status").isNull(), "not_ready").otherwise("ready_for_dispatch")
    return work.withColumns({"next_queue": queue, "reason": reason})


# --- what may be promoted, advertised beside or reported ---

# fixed values
PROFANITY = [
    "씨발", "시발", "씨봉", "씹할", "좆", "존나", "졸라씨", "병신", "썅", "개새끼", "개년", "개놈", "미친놈", "미친년", "닥쳐", "꺼져라",
    "엿먹", "지랄발광", "ㅅㅂ", "ㅄ", "ㅈ같",
]
# fixed values
LEAD_UNSAFE = ["노브라", "가슴", "엉덩이", "속옷", "란제리", "비키니", "누드", "섹시", "몸매", "글래머", "시스루", "핫바디", "19금", "성인용"]
# fixed values
LOW_VALUE = [
    r"\d+\s*추\s*(가능|가나|가즈|고고|채워|모아|찍)", r"추천\s*(좀|한번|부탁)\s*(해|주|드)", r"(파티|길드|클랜|공대|스터디|팀원|인원)\s*모집",
    r"모집\s*(창|글|합니다|중)", r"^(출석|출첵|인증)\s*", r"(?i)^(테스트|test)\s*\d*$",
]
# fixed values
UNPROMOTABLE = [
    r"빨아(주|준|댄)", r"못생(남|녀)", r"(김치녀|한남충|된장녀|맘충)", r"(^|[^가-힣])(일베|메갈)(?![가-힣])",
    r"(^|[^가-힣])(일베|메갈)(의|는|가|를|에|와|과|도)(?![가-힣])", r"(성매매|몰카|불법촬영)",
]
SENSITIVE = ["politics", "religion"]


def _meets(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def promotable(title: Column, words: list[str] = PROFANITY, unpromotable: list[str] = UNPROMOTABLE, low: list[str] = LOW_VALUE) -> Column:
    """Whether a title may stand in front: three characters at least, no profanity, nothing demeaning, no begging, recruiting or testing."""
    from tidewell.functions.text import contains_any

    bare = F.trim(F.coalesce(title, F.lit("")))
    return ~(contains_any(title, words) | _meets(title, unpromotable) | (F.length(bare) < 3) | _meets(bare, low))


def ad_unsafe(topics: Column, category: Column, title: Column, words: list[str] = PROFANITY) -> Column:
    """Whether advertisements keep away: politics or religion by topic or category, or profanity."""
    from tidewell.functions.text import contains_any

    told = F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, SENSITIVE))), F.lit(False))
    return told | F.coalesce(category.isin(SENSITIVE), F.lit(False)) | contains_any(title, words)


def left_out_of_reports(topics: Column, category: Column, adult: Column, adult_source: Column) -> Column:
    told = F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, SENSITIVE))), F.lit(False))
    return told | F.coalesce(category.isin(SENSITIVE), F.lit(False)) | F.coalesce(adult, F.lit(False)) | F.coalesce(adult_source, F.lit(False))


def in_window(at: Column, now: Column, hours: float) -> Column:
    """Whether a time lies within the hours before now; unknown ones do."""
    return F.coalesce(hours_between(now, at) <= hours, F.lit(True))


def topics_of(title: Column, url: Column, source: Column, boards: list[tuple[str, str, str]], words: dict[str, list[str]]) -> Column:
    """Topics by the board a url names (source, pattern, topic), then by the words of a title, each once."""
    from tidewell.functions.text import contains_any

    by_board = [F.when((source == s) & F.coalesce(url.rlike(p), F.lit(False)), t) for s, p, t in boards]
    by_word = [F.when(contains_any(title, w), t) for t, w in words.items()]
    return F.array_distinct(F.array_compact(F.array(*by_board, *by_word)))


def https_url(url: Column, sound: Column) -> Column:
    """A plain url as a secure one where its source is known to serve it; empty ones are null."""
    return F.when(url == "", None).when(url.startswith("http://") & F.coalesce(sound, F.lit(False)), F.concat(F.lit("https://"), F.substring(url, 8, 1 << 20))).otherwise(url)


def image_url(url: Column, sound: Column) -> Column:
    """An absolute image url, secure where that is known to work; null for relative ones and others."""
    t = F.trim(url)
    whole = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)
    return F.when(whole.rlike("(?i)^https?://"), https_url(whole, sound))


def junk_image(url: Column) -> Column:
    """Whether an image url is a banner's or a placeholder's, or a video thumbnail without a proper id."""
    host, path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    # fixed values
    video = host.rlike(r"(^|\.)(youtube|ytimg)\.com$") & ~path.rlike(r"^/vi/[A-Za-z0-9_-]{11}/")
    return path.rlike(r"(?i)(?:^|/)(?:banner|banners|ad|ads|adimg)/") | path.rlike(r"(?i)(?:^|/)(?:test|sample|noimage|no_image|noimg|default|dummy|thumb_default)\.(?:png|jpe?g|gif|webp)$") | video


def safe_url(url: Column) -> Column:
    """Whether a url is of the web and names no local or private host."""
    host = F.lower(F.regexp_extract(url, r"(?i)^\s*https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    local = bare.rlike(r"^(localhost|0\.0\.0\.0|::|::1)$|\.(localhost|local|internal)$")
    private = bare.rlike(r"^(127|10|0)(\.\d{1,3}){3}$|^172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2}$|^(192\.168|169\.254)(\.\d{1,3}){2}$|^f[cd][0-9a-f]{2}:|^fe80:")
    return F.coalesce((bare != "") & ~local & ~private, F.lit(False))


def overseas(lang: Column, original: Column, translated: Column) -> Column:
    """Of another language than Korean, now or originally, or translated."""
    return F.coalesce(original != "ko", F.lit(False)) | F.coalesce(lang != "ko", F.lit(False)) | F.coalesce(translated, F.lit(False))


def foreign(original: Column, translated: Column, needs: Column) -> Column:
    """Translated, to be translated, or originally of another language; the language now doesn't count."""
    return F.coalesce(translated, F.lit(False)) | F.coalesce(needs, F.lit(False)) | F.coalesce(original != "ko", F.lit(False))


def post_errors(title: Column, body: Column, tags: Column, recent: Column, banned: list[str], least: int = 2, most: int = 120, body_most: int = 2000, tags_most: int = 8, per_window: int = 5) -> Column:
    """What is wrong with a post, as an array: its title's length, its body's, its tags, a banned word, too many of late."""
    from tidewell.functions.text import contains_any

    size = F.length(F.trim(F.coalesce(title, F.lit(""))))
    return F.array_compact(
        F.array(
            F.when(size < least, "title short"),
            F.when(size > most, "title long"),
            F.when(F.length(F.coalesce(body, F.lit(""))) > body_most, "body long"),
            F.when(F.coalesce(F.size(tags), F.lit(0)) > tags_most, "tags"),
            F.when(contains_any(F.concat_ws(" ", title, body), banned), "banned"),
            F.when(F.coalesce(recent, F.lit(0)) >= per_window, "rate"),
        )
    )


# fixed values
METRIC_CLAIM = r"(추천|댓글|조회|반응|좋아요)\s*(수|가|은|는|이)?\s*[0-9〇一二三四五六七八九十百千万億일이삼사오육칠팔구십백천만억하나둘셋넷다섯여섯일곱여덟아홉열스물서른마흔쉰수몇여러]|[0-9〇一二三四五六七八九十百千万億일이삼사오육칠팔구십백천만억하나둘셋넷다섯여섯일곱여덟아홉열스물서른마흔쉰수몇여러][여만천]?\s*(건|개|명|회)\s*(의)?\s*(추천|댓글|조회|반응)"


def sound_paragraph(text: Column, source: Column, least: int = 40, most: int = 700) -> Column:
    """Whether a written paragraph has a fit length, no markup, no number its source hasn't, and no claim of reactions."""
    t = F.trim(text)
    numbers = F.regexp_extract_all(t, F.lit("[0-9]+"), 0)
    known = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit("[0-9]+"), 0)
    fit = F.length(t).between(least, most) & ~t.rlike("<[^>]+>") & (F.size(F.array_except(numbers, known)) == 0) & ~t.rlike(METRIC_CLAIM)
    return F.coalesce(fit, F.lit(False))


# Words that advertise more than is known, claims of having used what is sold, and claims without ground.
BANNED_COPY = "최저가|최저 가|역대급|지금만|오늘만|마감임박|한정|초특가|공짜|무료 증정|폭탄|떨이"
CLAIMED_USE = r"이거\s*(진짜|정말|완전)|써\s*보니|먹어\s*보니|입어\s*보니|읽어\s*보니|받아\s*보니|후기|내돈내산|재구매"
BANNED_CLAIMS = [
    r"업계\s*1위", r"판매\s*1위", "최저가", "무조건", r"100%\s*(보장|확실|만족)", "보장(합니다|돼요|됩니다|해요)", r"\d+(\.\d+)?%\s*(덜|줄어|감소|늘어|증가)",
    r"\d+\s*(명|개)\s*(이|가)?\s*(구매|판매|주문|샀)", r"후기\s*\d+(\.\d+)?\s*점", r"리뷰\s*\d+",
]
#: Lengths of the parts of an advert's card.
CARD = {"hook": (6, 30), "line": (10, 46), "cta": (3, 12)}


def sound_copy(text: Column, least: int, most: int) -> Column:
    """Whether an advert's words have a fit length and no digit, percent sign, markup, banned word or claim of use; null isn't sound."""
    t = F.trim(text)
    return F.coalesce(F.length(t).between(least, most) & ~t.rlike("[0-9%％]") & ~t.rlike(BANNED_COPY) & ~t.rlike(CLAIMED_USE) & ~t.rlike("<[^>]+>"), F.lit(False))


def sound_card(hook: Column, line: Column, cta: Column) -> Column:
    """Whether all three parts of a card are sound; one that isn't spoils it."""
    parts = {"hook": hook, "line": line, "cta": cta}
    return sound_copy(parts["hook"], *CARD["hook"]) & sound_copy(parts["line"], *CARD["line"]) & sound_copy(parts["cta"], *CARD["cta"])


def banned_claim(text: Column) -> Column:
    """Whether words claim a rank, a certainty, an effect or a number of buyers or reviews that nobody has measured."""
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in BANNED_CLAIMS)), F.lit(False))


# --- joins ---


def interest_matches(items: DataFrame, interests: DataFrame) -> DataFrame:
    """(id, term, value, how) of items (id, title, summary) and terms searched for (term, traffic, news): the best of each item.

    A term that title or summary names counts its traffic; one of whose news
    shares two long words with the title counts 0.6 of it. Terms are a short list,
    which is broadcast; news are met by their words, not against every title.
    """
    from tidewell.functions.text import long_words, mentions

    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    terms = F.broadcast(interests.select("term", "traffic"))
    named = items.join(terms, mentions(hay, F.col("term"))).select("id", "term", F.col("traffic").cast("double").alias("value"), F.lit("term").alias("how"))
    news = interests.select("term", "traffic", F.posexplode("news").alias("no", "n"))
    told = news.select("term", "traffic", "no", F.explode(F.array_distinct(long_words(F.col("n")))).alias("w"))
    words = items.select("id", F.explode(long_words(F.col("title"))).alias("w"))
    shared = words.join(F.broadcast(told), "w").groupBy("id", "term", "traffic", "no").agg(F.count("*").alias("n")).filter("n >= 2")
    near = shared.select("id", "term", (F.col("traffic") * 0.6).alias("value"), F.lit("news").alias("how")).distinct()
    near = near.join(named.select("id", "term"), ["id", "term"], "left_anti")
    best = F.max_by(F.struct("term", "value", "how"), F.struct("value", "term")).alias("b")
    return named.union(near).groupBy("id").agg(best).select("id", "b.*")


def trend_hits(trends: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, hits) of trends (name): titles that hold the name without its mark, of two characters at least, in any case."""
    bare = F.lower(F.regexp_replace("name", "^#", ""))
    short = F.broadcast(trends.select("name", bare.alias("q")).filter(F.length("q") >= 2))
    met = titles.join(short, F.contains(F.lower("title"), F.col("q"))).groupBy("name").agg(F.count("*").alias("hits"))
    return trends.join(met, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"))


def identities(visits: DataFrame, sessions: DataFrame, users: DataFrame, devices: DataFrame) -> DataFrame:
    """``visits`` (session, device, visitor, claimed) with who it is and how that is known: by login, cookie, visitor mark or the browser's own store; a claimed id of fit form starts a new one."""
    known = users.select("user_id")
    rows = visits.join(sessions.join(known, "user_id", "left_semi").select("session", F.col("user_id").alias("__s")), "session", "left")
    rows = rows.join(known.select(F.col("user_id").alias("device"), F.col("user_id").alias("__d")), "device", "left")
    rows = rows.join(devices.select("visitor", F.col("user_id").alias("__v")), "visitor", "left")
    rows = rows.join(known.select(F.col("user_id").alias("claimed"), F.col("user_id").alias("__c")), "claimed", "left")
    fit = F.when(F.col("claimed").rlike("^[A-Za-z0-9_-]{1,64}$"), F.col("claimed"))
    how = F.when(F.col("__s").isNotNull(), "login").when(F.col("__d").isNotNull(), "cookie").when(F.col("__v").isNotNull(), "visitor").when(F.col("__c").isNotNull(), "storage").otherwise("new")
    return rows.withColumns({"who": F.coalesce("__s", "__d", "__v", "__c", fit), "how": how}).drop("__s", "__d", "__v", "__c")


def archive_neighbours(days: DataFrame) -> DataFrame:
    """(day, before, after) of archived days. Days are few: one a day since the archive began."""
    from pyspark.sql import Window

    w = Window.orderBy("day")
    return days.select("day").distinct().withColumns({"before": F.lag("day").over(w), "after": F.lead("day").over(w)})


def edition_for(asked: DataFrame, editions: DataFrame) -> DataFrame:
    """``asked`` (day, slot) with the edition of that day and slot, else of the day before, else `live`."""
    rows = asked.join(editions.select("day", "slot", F.col("edition").alias("__a")), ["day", "slot"], "left")
    before = editions.select(F.date_add("day", 1).alias("day"), "slot", F.col("edition").alias("__b"))
    return rows.join(before, ["day", "slot"], "left").select("day", "slot", F.coalesce("__a", "__b", F.lit("live")).alias("edition"))


RUDE_MASK = "●"


def masked(text: Column, words: list[str] = PROFANITY, mark: str = RUDE_MASK) -> Column:
    """Each listed word's characters after its first as marks, words in their order; a single character all."""
    out = text
    for w in words:
        out = F.replace(out, F.lit(w), F.lit(mark if len(w) == 1 else w[0] + mark * (len(w) - 1)))
    return out


def normalized(raw: DataFrame, categories: list[str]) -> DataFrame:
    """Raw rows as items: unknown categories are news, kinds but `community` too, own and seed texts keep 1,000 characters and others 200, numbers that are missing are 0.

    ``raw`` has id, source, category, kind, via, title, summary, url, image,
    https_ok, score, comment_count, view_count, coverage, length and published_at.
    A count of views of 0 is unknown; words are counted where no length is told.
    """
    zero = F.lit(0)
    own = F.col("via").isNull() | F.col("via").isin("me", "seed")
    text = F.coalesce("summary", F.lit(""))
    words = F.regexp_count(text, F.lit("[^ \\t\\r\\n]+"))
    return raw.select(
        "id",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.when(F.col("category").isin(categories), F.col("category")).otherwise("news").alias("category"),
        F.when(F.col("kind") == "community", "community").otherwise("news").alias("kind"),
        F.coalesce("via", F.lit("seed")).alias("via"),
        F.substring(F.coalesce("title", F.lit("")), 1, 300).alias("title"),
        F.when(own, F.substring(text, 1, 1000)).otherwise(F.substring(text, 1, 200)).alias("summary"),
        https_url(F.col("url"), F.col("https_ok")).alias("url"),
        image_url(F.col("image"), F.col("https_ok")).alias("image"),
        *[F.coalesce(c, zero).alias(c) for c in ("score", "comment_count", "coverage")],
        F.when(F.col("view_count") > 0, F.col("view_count")).alias("view_count"),
        F.coalesce("length", words).cast("long").alias("length"),
        "published_at",
    )
