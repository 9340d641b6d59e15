"""Order-dependent selection: pages, interleaves, shares and caps, where each choice depends on those before.

What is greedy runs on one reader's list (or one edition's) at a time, which a
task holds whole: it is as long as what that reader was offered. Where only the
first so many of a list count, Spark cuts it by a window before. A kernel takes a
list as a pandas frame in order and gives the positions it puts out.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: str) -> Column:
    return F.desc(by.removesuffix(" desc")) if by.endswith(" desc") else F.asc(by)


def arranged(rows: DataFrame, by: str, kernel: Callable[[pd.DataFrame], list[int]], order: list[str], most: int | None = None) -> DataFrame:
    """(by, id, place): each group's rows by ``order``, put out as ``kernel`` has them; place from 0.

    All rows count, or with ``most`` each group's first ones alone: what is beyond
    them is left out of the result, so it is for pages that never get there. Sorted
    groups come to a task many at a time, since one call a group takes longer than
    most kernels do.
    """
    cut = rows
    if most is not None:
        w = Window.partitionBy(by).orderBy(*map(_order, order))
        cut = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")

    def work(frames):
        held: list[pd.DataFrame] = []  # of the group that may go on in the next frame

        def put(frame: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
            at = [np.asarray(kernel(frame.iloc[a:b].reset_index(drop=True)), dtype=np.int64) + a for a, b in zip([0, *ends], ends, strict=False)]
            place = np.concatenate([np.arange(len(x)) for x in at])
            at = np.concatenate(at)
            return pd.DataFrame({by: frame[by].iloc[at].to_numpy(), "id": frame["id"].iloc[at].to_numpy(), "place": place})

        for frame in frames:
            if not len(frame):
                continue
            group = frame[by] if not held else pd.concat([held[-1][by].iloc[-1:], frame[by]])
            code = pd.factorize(group, use_na_sentinel=False)[0]
            starts = np.flatnonzero(code[1:] != code[:-1]) + (0 if held else 1)
            if not len(starts):
                held.append(frame)
                continue
            whole = pd.concat([*held, frame], ignore_index=True)
            ends = (starts + len(whole) - len(frame)).tolist()
            yield put(whole, ends)
            held = [whole.iloc[ends[-1] :].reset_index(drop=True)]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield put(whole, [len(whole)])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return cut.repartition(by).sortWithinPartitions(by, *map(_order, order)).mapInPandas(work, f"{by} {kinds[by]}, id {kinds['id']}, place long")


def diverse_page(limit: int = 10, first_page: bool = True, min_gap: int = 1, mix: float = 0.0) -> Callable[[pd.DataFrame], list[int]]:
    """A page of candidates (score, key, category, kind, exposure, stance, has_picks).

    Hated categories are out. A key (source or its group) fills a fifth of the
    page at most, more or less by kind with ``mix``; a picked category 60 %, any
    other 30 %, all others together a fifth where the reader has picks. Picked
    categories get 60 % of the first page (later half), others a fifth, as far as
    there are any; once the slots left are all owed, only those owed may take them.
    Where nothing fits, category caps give way first, then key caps, then the gap.
    Among what fits the score counts, less 0.55 ln(1 + exposure), 0.2 for each
    earlier pick of the key and 0.25 of the category.
    """

    def kernel(c: pd.DataFrame) -> list[int]:
        order = np.flatnonzero((c["stance"] != "hated").to_numpy())
        score = c["score"].to_numpy(float)
        order = order[np.argsort(-score[order], kind="stable")]
        n = len(order)
        if not n:
            return []
        key, category = (pd.factorize(c[x].iloc[order].fillna("?"))[0] for x in ("key", "category"))
        picked = (c["stance"].iloc[order] == "picked").to_numpy()
        base = score[order] - 0.55 * np.log1p(c["exposure"].to_numpy(float)[order])
        cap = max(1, math.ceil(0.2 * limit))
        towards = c["kind"].iloc[order].map({"news": 1.0, "community": -1.0}).fillna(0.0).to_numpy()
        key_cap = np.maximum(1, np.floor(cap * (1 + towards * mix * 0.8) + 0.5)) if mix else np.full(n, cap)
        category_cap = np.where(picked, max(1, math.ceil(0.6 * limit)), max(1, math.ceil(0.3 * limit)))
        has_picks = bool(c["has_picks"].iloc[0])
        owed_picked = min(math.ceil((0.6 if first_page else 0.5) * limit) if has_picks else 0, int(picked.sum()))
        owed_other = min(math.ceil(0.2 * limit), int((~picked).sum()))
        other_cap = math.ceil(0.2 * limit) if has_picks else n
        free = np.ones(n, bool)
        by_key, by_category = np.zeros(key.max() + 1, int), np.zeros(category.max() + 1, int)
        out: list[int] = []
        while len(out) < min(limit, n):
            got = int(picked[out].sum())
            short_picked, short_other = max(0, owed_picked - got), max(0, owed_other - (len(out) - got))
            may = free.copy()
            if short_picked + short_other >= limit - len(out):
                may &= (picked & (short_picked > 0)) | (~picked & (short_other > 0))
            fits_category = (by_category[category] < category_cap) & (picked | (len(out) - got < other_cap))
            fits_key = by_key[key] < key_cap
            fits_gap = ~np.isin(key, key[out[-min_gap:]]) if min_gap else np.ones(n, bool)
            for fits in (fits_category & fits_key & fits_gap, fits_key & fits_gap, fits_gap, np.ones(n, bool)):
                if (may & fits).any():
                    may &= fits
                    break
            if not may.any():
                break
            best = int(np.argmax(np.where(may, base - 0.2 * by_key[key] - 0.25 * by_category[category], -np.inf)))
            out.append(best)
            free[best] = False
            by_key[key[best]] += 1
            by_category[category[best]] += 1
        return order[out].tolist()

    return kernel


def diversified(source: float = 0.6, category: float = 0.4, window: int = 4) -> Callable[[pd.DataFrame], list[int]]:
    """All rows by (score, source, category): each of the last picks takes from candidates that share its source or category."""

    def kernel(c: pd.DataFrame) -> list[int]:
        sources, categories = (pd.factorize(c[x].fillna("?"))[0] for x in ("source", "category"))
        value, out = c["score"].to_numpy(float).copy(), []
        for _ in range(len(c)):
            took = np.zeros(len(c))
            for p in out[-window:]:
                took += source * (sources == sources[p]) + category * (categories == categories[p])
            best = int(np.argmax(value - took))
            out.append(best)
            value[best] = -np.inf
        return out

    return kernel


def round_robin(min_gap: int = 1, penalty: float = 1.0) -> Callable[[pd.DataFrame], list[int]]:
    """Rows (key, source, hot, exposure, weight), of each key in their order: the head of greatest hot goes next, less ``penalty`` ln(1 + shown / weight).

    Equal heads go by fewest shown, then by the key that came first. A key waits
    while one of the last ``min_gap`` rows has it as source.
    """

    def kernel(c: pd.DataFrame) -> list[int]:
        queues: dict = {}
        for i, k in enumerate(c["key"]):
            queues.setdefault(k, deque()).append(i)
        hot, source = c["hot"].to_numpy(float), c["source"].tolist()
        weight = {k: float(c["weight"].iloc[q[0]]) for k, q in queues.items()}
        shown = {k: float(c["exposure"].iloc[q[0]]) for k, q in queues.items()}
        out: list[int] = []
        while queues:
            heads = sorted(queues, key=lambda k: (penalty * math.log1p(shown[k] / weight[k]) - hot[queues[k][0]], shown[k] / weight[k]))
            recent = [source[i] for i in out[-min_gap:]] if min_gap else []
            k = next((k for k in heads if k not in recent), heads[0])
            out.append(queues[k].popleft())
            shown[k] += 1
            if not queues[k]:
                del queues[k]
        return out

    return kernel


def latest(bucket_hours: float = 0.5, cap: int = 2) -> Callable[[pd.DataFrame], list[int]]:
    """Rows (age, source, prefer) in buckets of age: sources take turns in a bucket, ``cap`` rows each at most; what is over waits for the next bucket.

    Preferred sources go first in a bucket, then those of the youngest row. After
    the last bucket the rest takes turns without a cap. Nothing is dropped.
    """

    def turns(waiting: list[int], source: list, order: Callable, most: float) -> tuple[list[int], list[int]]:
        queues: dict = {}
        for i in waiting:
            queues.setdefault(source[i], []).append(i)
        ordered = sorted(queues.values(), key=order) if order else list(queues.values())
        rounds = max((len(q) for q in ordered), default=0)
        out = [q[r] for r in range(int(min(rounds, most))) for q in ordered if r < len(q)]
        return out, [i for q in ordered for i in q[int(min(len(q), most)) :]]

    def kernel(c: pd.DataFrame) -> list[int]:
        age, prefer = c["age"].fillna(0.0).clip(lower=0).to_numpy(float), c["prefer"].to_numpy(float)
        source, bucket = c["source"].fillna("?").tolist(), np.floor(age / bucket_hours)
        out, carried = [], []
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            own = own[np.argsort(age[own], kind="stable")].tolist()
            done, carried = turns(carried + own, source, lambda q: (-max(prefer[i] for i in q), min(age[i] for i in q)), cap)
            out += done
        return out + turns(carried, source, None, math.inf)[0]

    return kernel


def deals_capped(share: float = 0.08, gap: int = 6) -> Callable[[pd.DataFrame], list[int]]:
    """Rows (deal, ours, heat): of the deals the hottest, a share of the list and one at least, stay where they are, ``gap`` places apart; others go to the end.

    Our own deals always stay.
    """

    def kernel(c: pd.DataFrame) -> list[int]:
        deal, ours = c["deal"].to_numpy(bool), c["ours"].to_numpy(bool)
        if deal.sum() <= 1:
            return list(range(len(c)))
        kept, heat = np.flatnonzero(deal & ours).tolist(), c["heat"].to_numpy(float)
        rivals = np.flatnonzero(deal & ~ours)
        room = max(1, math.floor(len(c) * share))
        for i in rivals[np.argsort(-heat[rivals], kind="stable")]:
            if not room:
                break
            if all(abs(i - k) >= gap for k in kept):
                kept.append(int(i))
                room -= 1
        front = ~deal
        front[kept] = True
        return [*np.flatnonzero(front).tolist(), *np.flatnonzero(~front).tolist()]

    return kernel


def deals_ensured(share: float = 0.12) -> Callable[[pd.DataFrame], list[int]]:
    """Rows (deal, spare): spare deals are put between the others, at even steps, until deals have their share."""

    def kernel(c: pd.DataFrame) -> list[int]:
        spare = c["spare"].to_numpy(bool)
        out, pool = np.flatnonzero(~spare).tolist(), np.flatnonzero(spare).tolist()
        need = max(0, math.floor(len(out) * share) - int(c["deal"].to_numpy(bool)[out].sum()))
        step = max(2, len(out) // (need + 1))
        for k, i in enumerate(pool[:need] if out else []):
            out.insert(min(len(out), (k + 1) * step + k), i)
        return out

    return kernel


def taste_ensured(share: float = 0.6) -> Callable[[pd.DataFrame], list[int]]:
    """Rows (chosen, spare): spare rows of chosen categories come in at even steps until these have their share; the list keeps its length."""

    def kernel(c: pd.DataFrame) -> list[int]:
        spare, chosen = c["spare"].to_numpy(bool), c["chosen"].to_numpy(bool)
        rest = np.flatnonzero(~spare).tolist()
        n = len(rest)
        need = math.ceil(n * share) - int(chosen[rest].sum())
        extra = np.flatnonzero(spare & chosen).tolist()[: max(0, need)]
        if not extra:
            return rest
        step, out, turn = max(1, math.floor(n / (len(extra) + 1) + 0.5)), [], 0
        rest, extra = deque(rest), deque(extra)
        while len(out) < n:
            due = extra and turn > 0 and turn % step == 0
            out.append((extra if due or not rest else rest).popleft())
            turn += 1
        return out

    return kernel


def foreign_ensured(share: float = 0.1, window: int = 20) -> Callable[[pd.DataFrame], list[int]]:
    """Rows (foreign, spare, fixed): the first screen holds a share of foreign rows, one at least, by trades for rows further back, then for spare ones.

    Places are spread evenly, the first and fixed ones left alone, and neighbours
    of foreign rows taken last. Lists of fewer than five rows stay as they are.
    """

    def kernel(c: pd.DataFrame) -> list[int]:
        spare, foreign, fixed = (c[x].to_numpy(bool) for x in ("spare", "foreign", "fixed"))
        out = np.flatnonzero(~spare).tolist()
        win = min(window, len(out))
        at = {s for s in range(win) if foreign[out[s]]}
        need = max(1, math.floor(win * share)) - len(at)
        if win < 5 or need <= 0:
            return out
        behind = [s for s in range(win, len(out)) if foreign[out[s]]]
        donors = [(s, None) for s in behind] + [(None, i) for i in np.flatnonzero(spare & foreign)]
        donors = donors[:need]
        step = max(2, win // (len(donors) + 1))
        for k, (back, new) in enumerate(donors):
            want = min(win - 1, step * (k + 1))
            open_ = [s for s in range(1, win) if s not in at and not fixed[out[s]]]
            if not open_:
                continue
            slot = min(open_, key=lambda s: (s - 1 in at or s + 1 in at, abs(s - want), s))
            at.add(slot)
            if back is None:
                out[slot] = int(new)
            else:
                out[slot], out[back] = out[back], out[slot]
        return out

    return kernel


def one_category_capped(rows: DataFrame, by: str, order: list[Column], share: float = 0.85, least: int = 5) -> DataFrame:
    """``rows`` with place from 1: what a category has beyond its share of the list goes to the end, in order. Windows say it all."""
    w, c = Window.partitionBy(by), Window.partitionBy(by, "category").orderBy(*order)
    over = (F.row_number().over(c) > F.floor(F.count("*").over(w) * share)) & (F.count("*").over(w) >= least)
    marked = rows.withColumn("__over", over)
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__over", *order))).drop("__over")


def top_of_events(rows: DataFrame, by: str, n: int, per_source: int, value: str = "value") -> DataFrame:
    """(by, id, place): the n best of each group, ``per_source`` of a source at most and no event (key) twice; a row that is skipped claims neither.

    Of a source's rows with one key only the best can be chosen, and no more than
    n + per_source of its keys; the rest is cut before anything is gathered.
    """
    first = Window.partitionBy(by, "source", "key").orderBy(F.desc(value), "ord")
    once = rows.withColumn("__f", F.row_number().over(first)).filter("key is null or __f = 1").drop("__f")
    few = Window.partitionBy(by, "source").orderBy(F.desc(value), "ord")
    few_rows = once.withColumn("__s", F.row_number().over(few)).filter(F.col("__s") <= n + per_source).drop("__s")

    def kernel(c: pd.DataFrame) -> list[int]:
        out, taken, told = [], Counter(), set()
        for i, (source, key) in enumerate(zip(c["source"], c["key"], strict=True)):
            if len(out) == n:
                break
            if taken[source] >= per_source or (key is not None and key in told):
                continue
            out.append(i)
            taken[source] += 1
            told.add(key)
        return out

    return arranged(few_rows.select(by, "id", "source", "key", value, "ord"), by, kernel, [f"{value} desc", "ord"])


def clustered(rows: DataFrame, by: str, order: list[str], shared: int = 2, most: int | None = None, step: int = 1 << 14) -> DataFrame:
    """(by, id, issue, place): rows (id, key, tags) of each group in order join the first issue that has their event key or a row with ``shared`` equal tags.

    All rows of a group count, or with ``most`` its first ones alone. Pairs of
    tags are indexed for ``step`` rows at a time; another number of ``shared`` tags
    has rows compared with all before them.
    """
    w = Window.partitionBy(by).orderBy(*map(_order, order))
    few = rows.withColumn("__r", F.row_number().over(w)).select(by, "id", "key", "tags", "__r")
    few = few if most is None else few.filter(F.col("__r") <= most)

    def first_sharing(tags: list, keys: list) -> list[int]:
        """Each row's issue: of every pair of tags the first issue that has it is kept, so no row is compared with those before it."""
        lengths = np.array([len(t) for t in tags])
        row = np.repeat(np.arange(len(tags)), lengths)
        tag, names = pd.factorize(np.array([t for x in tags for t in x], dtype=object))
        whole = np.unique(row * max(1, len(names)) + tag)
        row, tag = whole // max(1, len(names)), whole % max(1, len(names))
        common = np.bincount(tag, minlength=len(names))[tag] > 1  # a tag of one row is shared with none
        row, tag = row[common], tag[common]
        # every pair of a row's tags is its later one with each before it
        before = np.arange(len(row)) - np.searchsorted(row, row)
        known, issue, none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.iinfo(np.int64).max
        of_key: dict = {}
        out: list[int] = []
        count = 0
        for r in range(0, len(tags), step):
            lo, hi = np.searchsorted(row, [r, r + step])
            n = before[lo:hi]
            later = np.repeat(np.arange(lo, hi), n)
            back = np.arange(len(later)) - np.repeat(np.cumsum(n) - n, n) + 1
            pairs, at = np.unique(tag[later - back] * len(names) + tag[later], return_inverse=True)
            ends = np.searchsorted(row[later], np.arange(r, min(r + step, len(tags)) + 1))
            place = np.searchsorted(known, pairs)
            met = np.zeros(len(pairs), bool) if not len(known) else known[np.minimum(place, len(known) - 1)] == pairs
            first = np.full(len(pairs), none)
            first[met] = issue[place[met]]
            for i in range(len(ends) - 1):
                mine, key = at[ends[i] : ends[i + 1]], keys[r + i]
                found = int(first[mine].min()) if len(mine) else none
                if key is not None:
                    found = min(found, of_key.get(key, none))
                if found == none:
                    found, count = count, count + 1
                first[mine] = found
                if key is not None:
                    of_key[key] = found
                out.append(found)
            issue[place[met]] = first[met]
            known, issue = np.concatenate([known, pairs[~met]]), np.concatenate([issue, first[~met]])
            order = np.argsort(known, kind="stable")
            known, issue = known[order], issue[order]
        return out

    def first_compared(tags: list, keys: list) -> list[int]:
        issues: list[list[tuple]] = []
        out = []
        for key, own in zip(keys, map(set, tags), strict=True):
            found = next((n for n, members in enumerate(issues) if any((k is not None and k == key) or len(t & own) >= shared for k, t in members)), len(issues))
            if found == len(issues):
                issues.append([])
            issues[found].append((key, own))
            out.append(found)
        return out

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__r")
        issue = (first_sharing if shared == 2 else first_compared)(group["tags"].tolist(), group["key"].tolist())
        taken: Counter = Counter()
        place = []
        for n in issue:
            place.append(taken[n])
            taken[n] += 1
        return pd.DataFrame({by: group[by], "id": group["id"], "issue": issue, "place": place})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return few.groupBy(by).applyInPandas(work, f"{by} {kinds[by]}, id {kinds['id']}, issue long, place long")


def issue_weights(members: DataFrame, by: str) -> DataFrame:
    """(by, issue, source, weight) of issues from members (issue, place, source, score, comment_count, coverage, interest, weighty): reactions by logarithm, coverage, interest, weighty categories."""
    reactions = F.sum(F.col("score") + 2 * F.col("comment_count"))
    return members.groupBy(by, "issue").agg(
        F.min_by("source", "place").alias("source"),
        (
            60 * F.log10(1 + F.greatest(F.lit(0), reactions))
            + 80 * F.greatest(F.lit(0), F.max("coverage"))
            + 250 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("interest")) / 1000)
            + F.when(F.max(F.col("weighty").cast("int")) > 0, 105).otherwise(0)
        ).alias("weight"),
    )


def balanced(issues: DataFrame, by: str, n: int = 6, per_source: int = 2) -> DataFrame:
    """``issues`` (by, issue, source, weight) of a digest with place from 1: the n heaviest with ``per_source`` of a source; if these are too few, the heaviest of the others after them."""
    heavy = [F.desc("weight"), F.asc("issue")]
    own = F.row_number().over(Window.partitionBy(by, "source").orderBy(*heavy))
    rows = issues.withColumn("__extra", own > per_source)
    place = F.row_number().over(Window.partitionBy(by).orderBy("__extra", *heavy))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("__extra")


def folded_batch(rows: DataFrame, by: str) -> DataFrame:
    """(by, id, coverage, related) of the rows that stay of each collected batch: (id, url, key, source, kind, coverage, ord).

    A row whose url (else id) is kept already goes. One whose event key is kept
    already folds into that row: its source is listed as related, five at most and
    each once; between news of two sources it also raises coverage to the number
    of sources, five at most.
    """

    def work(group: pd.DataFrame) -> pd.DataFrame:
        kept, urls, events = [], set(), {}
        for r in group.sort_values("ord").itertuples(index=False):
            name = r.url if r.url is not None else ("id", r.id)
            if name in urls:
                continue
            first = events.get(r.key) if r.key is not None else None
            if first is None:
                urls.add(name)
                kept.append({"id": r.id, "source": r.source, "kind": r.kind, "coverage": int(r.coverage), "related": []})
                if r.key is not None:
                    events[r.key] = kept[-1]
                continue
            if r.source is None or r.source == first["source"] or r.source in first["related"]:
                continue
            if "community" not in (r.kind, first["kind"]):
                first["coverage"] = max(first["coverage"], min(len(first["related"]) + 2, 5))
            if len(first["related"]) < 5:
                first["related"].append(r.source)
        return pd.DataFrame([{by: group[by].iloc[0], "id": k["id"], "coverage": k["coverage"], "related": ",".join(k["related"])} for k in kept])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [by, "id", "url", "key", "source", "kind", "coverage", "ord"]
    return rows.select(*columns).fillna(0, ["coverage"]).groupBy(by).applyInPandas(work, f"{by} {kinds[by]}, id {kinds['id']}, coverage long, related string")


def with_slots(candidates: list[dict], every: int = 6, skip: int = 3, most: int = 2, least: float = 0.3, wait: int = 3, start: int = 0) -> Callable[[pd.DataFrame], list[int]]:
    """Positions of rows (unsafe, deal_dest, ad_dest) with -1 - k where candidate k (relevance, dest, claims) is put.

    One is due at every ``every``-th row from ``skip`` on, counted over the whole
    session from ``start``, and stays due until it can be placed: never beside an
    unsafe row, ``most`` a page. Relevant candidates are used, else those without
    claims; one for the destination of the row above is preferred. Without such a
    row it waits for a deal within the next ``wait`` rows. ``candidates`` is one
    page's short list.
    """
    fit = [k for k, c in enumerate(candidates) if c["relevance"] >= least] or [k for k, c in enumerate(candidates) if not c["claims"]]

    def kernel(c: pd.DataFrame) -> list[int]:
        unsafe = c["unsafe"].tolist()
        deal = [d if isinstance(d, str) else None for d in c["deal_dest"]]
        dest = [d or (a if isinstance(a, str) else None) for d, a in zip(deal, c["ad_dest"], strict=True)]
        left, out, placed, due = list(fit), [], 0, False
        for i in range(len(c)):
            due = due or (every > 0 and start + i >= skip and (start + i - skip) % every == 0)
            above = dest[i - 1] if i else None
            held = unsafe[i] or (i > 0 and unsafe[i - 1]) or (above is None and any(deal[i : i + wait]))
            if due and left and placed < most and not held:
                want = above or dest[i]
                k = next((k for k in left if want and candidates[k]["dest"] == want), left[0])
                left.remove(k)
                out.append(-1 - k)
                placed, due = placed + 1, False
            out.append(i)
        return out

    return kernel
