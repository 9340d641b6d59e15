"""Decontamination, packing and id matrices against plain versions."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import words
from tokenizers import Tokenizer

from tidewell.llm import decontam, packing, tokenbin, tokens


@pytest.fixture(scope="module")
def plain(odd):
    """(doc_id, ids) of each odd document by the tokenizers library."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd[0]]


@pytest.mark.parametrize("limits", [{}, {"merge": 2, "most": 3}])
def test_packing(odd, none, plain, limits):
    pieces = packing.pack(odd[1], **limits).collect()
    ids = {d: np.array([*x, 0], "<u4") for d, x in plain}
    filled, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
        held[p["doc_id"]].append((p["start"], p["length"]))
    for runs in filled.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 1024
    twice = odd[0][0][0]
    for d, runs in held.items():
        assert sum(n for _, n in runs) == len(ids[d]) * (2 if d == twice else 1)
    assert len(filled) <= 1.1 * sum(len(x) + 1 for _, x in plain) / 1024 + (12 if limits else 2)
    assert packing.pack(none).count() == 0


def test_ids_of_very_long_blanks():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_500_000, "a" + " " * 1_500_000 + "b <|endoftext|>", "x" + "\n" * 1_000_000 + "y"):
        assert tokens.token_ids(tokens.default_path(), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_added_tokens():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"a  {end}  b\n{end}\n\n", f"x{end}y", "<|endoftext|", f"<|{end}|>", f"é{end}日本", "<|ENDOFTEXT|>", ""]
    for text in texts:
        assert tokens.token_ids(tokens.default_path(), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.token_ids(tokens.default_path(), texts[0]).tolist() == [64, 220, 50256, 275]


def test_open_windows_are_bounded_and_best_fit():
    windows = packing.OpenWindows(10, 2)
    assert windows.place(10) == (0, 0, None) and not windows.fills
    windows = packing.OpenWindows(10, 2)
    assert windows.place(6) == (0, 0, None) and windows.place(8) == (1, 0, None)
    assert windows.place(2) == (1, 8, None) and windows.place(5) == (2, 0, None)
    assert windows.place(9) == (3, 0, 0) and len(windows.fills) == 2


def test_matrices(spark, tmp_path, odd, none, plain):
    path = str(tmp_path / "m")
    tokenbin.write_matrices(tokenbin.packed_rows(odd[1], group=50), path)
    packed = tokenbin.read_matrices(spark, path)
    got = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in tokenbin.read_documents(packed).collect())
    assert got == sorted((d, [*x, tokenbin.END_ID]) for d, x in plain)
    for r in packed.collect():
        ids, positions = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(positions) == tokenbin.CAPACITY and r["cu_seqlens"][-1] == r["n_tokens"] <= tokenbin.CAPACITY
        assert (ids[r["n_tokens"] :] == tokenbin.PAD_ID).all() and tokenbin.PAD_ID not in ids[: r["n_tokens"]]
        for s, e in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert positions[s:e].tolist() == list(range(e - s))
    wide = tokenbin.read_documents(tokenbin.packed_rows(odd[1], width=4), width=4)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in wide.collect()) == got
    assert tokenbin.packed_rows(none).count() == 0
    with pytest.raises(ValueError, match="2 bytes"):
        tokenbin.packed_rows(odd[1], capacity=1 << 17)


def test_best_fit_decreasing():
    sizes = np.array([random.Random(1).randrange(1, 101) for _ in range(500)])
    rows = tokenbin.best_fit_decreasing(sizes, 100)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sizes[r].sum() <= 100 for r in rows)
    open_ = []
    for size in sorted(sizes.tolist(), reverse=True):
        fits = [(x, i) for i, x in enumerate(open_) if x >= size]
        if fits:
            open_[min(fits)[1]] -= size
        else:
            open_.append(100 - size)
    assert len(rows) == len(open_)


def _tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def _all_alignments(rows, items):
    """{(doc_id, item_id): most matches} over all shifts with an equal seed, of texts that overlap by the rule."""
    numbers, found = {}, {}

    def numbered(text):
        return np.array([numbers.setdefault(t, len(numbers)) for t in _tokens(text)])

    texts, wanted = [(r[0], numbered(r[1])) for r in rows], [(i, numbered(t)) for i, t in items]
    for doc, mine in texts:
        for item, want in wanted:
            for shift in range(1 - len(want), len(mine)) if len(np.intersect1d(mine, want)) else ():
                lo, hi = max(0, -shift), min(len(want), len(mine) - shift)
                equal = mine[lo + shift : hi + shift] == want[lo:hi]
                if not equal.any():
                    continue
                seeded = [decontam._SHAPES[x] for x in decontam.shapes_of(len(want))]
                if not any(len(equal) > s[-1] and np.logical_and.reduce([equal[x : len(equal) - s[-1] + x] for x in s]).any() for s in seeded):
                    continue
                matched = decontam.best_run(equal)[0]
                if matched >= decontam.needed(len(want)):
                    found[doc, item] = max(matched, found.get((doc, item), 0))
    return found


def test_decontamination(spark, none):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 40, 9000))) for i in range(20)]
    items += [(30 + n, " ".join(words(rng, n, 9000))) for n in range(1, 13)] + [(60, items[3][1]), (61, items[4][1] + " more")]
    rows, dirty = [], set()
    for i in range(96):
        text = words(rng, rng.randrange(30, 90), 9000)
        if i % 4 == 0:
            part = items[rng.randrange(20)][1].split()[5:35]
            for at in (7, 16, 25)[: i % 3]:
                part[at] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = part
            dirty.add(i)
        elif i % 4 == 1:
            # noise of every kind in a shorter part, which may overlap or not
            part = items[rng.randrange(20)][1].split()[: rng.randrange(8, 30)]
            text[5:5] = [w if rng.random() < 0.75 else "noise" for w in part]
        elif i % 8 == 2:
            text[9:9] = items[20 + i % 12][1].split()
        rows.append((i, " ".join(text).upper() if i % 8 == 0 else " ".join(text), None))
    rows += [(900, None, None), (901, "", None), (902, "w " * 50_000, None), (903, items[25][1], None), (8, rows[0][1], None), rows[4], (None, rows[8][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, items[0][1])], "item_id long, text string")
    want = _all_alignments([r for r in rows if r[0] != 902], items)
    for limits in ({}, {"max_bits": 64, "max_keys": 0, "meetings": 3}):
        got = decontam.benchmark_overlaps(docs, bench, **limits).collect()
        best = {}
        for r in got:
            best[r["doc_id"], r["item_id"]] = max(r["matched"], best.get((r["doc_id"], r["item_id"]), 0))
        assert best == want and len(got) == len(best) + sum(r["doc_id"] == 8 for r in got) - len({x for x in best if x[0] == 8})
    gone = {d for (d, _), m in want.items() if m >= decontam.LEAST_ITEM} | {903}
    assert dirty <= gone and None in gone
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in gone)
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert decontam.benchmark_overlaps(none, bench).count() == 0
