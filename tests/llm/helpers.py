"""Small hostile tables: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, stock: int = 400) -> list[str]:
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


def documents(seed: int = 5) -> list[tuple]:
    """Exact and near copies of many sizes, a passage that many texts share, and every odd text."""
    rng, texts = random.Random(seed), []
    passage = words(rng, 70)
    for size in (3, 4, 5, 8, 9, 20, 40, 66, 70, 130, 150, 300, 700):
        base = words(rng, size, 5000)
        for changes in (0, 0, 1, 2, 4, 7):
            copy = list(base)
            for _ in range(min(changes, size)):
                copy[rng.randrange(size)] = f"x{rng.randrange(9999)}"
            if changes == 7:
                copy += words(rng, size // 8)
            texts.append(" ".join(copy))
    texts += [" ".join([*words(rng, rng.randrange(5, 60)), *passage, *words(rng, rng.randrange(5, 60))]) for _ in range(40)]
    texts += [None, "", " \t\n", "One", "one", "ONE two", "ÄÖ äö ...", "word " * 30_000, "a" * 50_000, "\n\n", "1 2 3 4 5 6"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "en" if i % 4 else None, None if i % 9 == 0 else "hot", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[0]]


def shingles(text: str | None, n: int = 5) -> set:
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not found:
        return set()
    return {tuple(found)} if len(found) < n else {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest linked doc_id), from all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeated_lines(rows: list[tuple], least: int = 50) -> set:
    """(doc_id, line) of lines in later runs of at least so many words, by growing every pair of equal lines."""
    docs = []
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}):
        lines = [(i, x.replace("\t", " ").replace("\r", " ").strip(" ")) for i, x in enumerate(text.split("\n"))]
        docs.append((doc, [(i, x) for i, x in lines if x]))
    found = set()
    for k, (doc, mine) in enumerate(docs):
        for other, theirs in docs[: k + 1]:
            for i in range(len(mine)):
                for j in range(len(theirs) if other != doc else i):
                    if mine[i][1] != theirs[j][1] or (i and j and mine[i - 1][1] == theirs[j - 1][1]):
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n][1] == theirs[j + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in mine[i : i + n]) >= least:
                        found |= {(doc, at) for at, _ in mine[i : i + n]}
    return found
