import random
import zlib

from helpers import repeated_lines, words

from tidewell.llm import linededup


def _rows(seed):
    rng = random.Random(seed)
    stock = [" ".join(words(rng, rng.choice((2, 5, 9, 14, 30, 60)))) for _ in range(25)]
    passage = [" ".join(words(rng, n)) for n in (9, 12, 11, 12, 10)]
    rows = []
    for i in range(60):
        lines = [rng.choice([*stock, "", "  \t", f"own line {i} {rng.random()}"]) for _ in range(rng.randrange(1, 14))]
        if i % 5 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "x " * 20_000), (104, "x " * 20_000), (105, "same\n" * 80)]


def test_runs_match_all_pairs(spark):
    for seed in (1, 2):
        rows = _rows(seed)
        runs = linededup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        got = {(r["doc_id"], x) for r in runs for x in range(r["first_line"], r["last_line"] + 1)}
        blank = {(d, i) for d, t in rows if t for i, x in enumerate(t.split("\n")) if not x.strip()}
        assert got - blank == repeated_lines(rows) and all(r["words"] >= 50 for r in runs)


def test_stretches_of_equal_lines_match_all_pairs(spark):
    """Stretches of heavy and light lines, shorter and longer than what is kept of them, alone and between other lines."""
    rng = random.Random(11)
    stock = [" ".join(words(rng, n)) for n in (1, 2, 13, 20, 60)]
    sides = [" ".join(words(rng, n)) for n in (3, 8, 12, 14)]
    texts = []
    for _ in range(22):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += [rng.choice(sides) for _ in range(rng.randrange(3))]
            lines += [rng.choice(stock)] * rng.choice((1, 2, 3, 4, 5, 7, 12, 60, 120))
            lines += [""] * rng.randrange(2)
        texts.append("\n".join(lines + [rng.choice(sides) for _ in range(rng.randrange(3))]))
    rows = list(enumerate(texts))
    runs = linededup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], x) for r in runs for x in range(r["first_line"], r["last_line"] + 1)}
    blank = {(d, i) for d, t in rows for i, x in enumerate(t.split("\n")) if not x.strip()}
    assert got - blank == repeated_lines(rows)
    for r in runs:
        assert r["words"] == sum(len(x.split()) for x in texts[r["doc_id"]].split("\n")[r["first_line"] : r["last_line"] + 1]) >= 50


def test_a_log_of_equal_lines_is_one_run(spark):
    heavy, light = " ".join(f"w{i}" for i in range(14)), "x y"
    rows = [(1, "\n".join([heavy] * 20_000)), (2, "\n".join([light] * 100_000)), (3, "\n".join(["a", *[light] * 50_000, "b"]))]
    runs = {tuple(r) for r in linededup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r for r in runs if r[0] < 3} == {(1, 1, 19_999, 14 * 19_999, 1, 0), (2, 1, 99_999, 2 * 99_999, 2, 0)}
    # the third repeats the second wherever the ends of both stretches can lie
    assert {r[4] for r in runs if r[0] == 3} == {2} and {(min(r[1] for r in runs if r[0] == 3), max(r[2] for r in runs if r[0] == 3))} == {(1, 50_000)} and len(runs) < 60


def test_native_plan(spark):
    docs = spark.createDataFrame(_rows(1), "doc_id long, text string")
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_dedup_deletes_later_runs_alone(spark):
    first = "\n".join(["head"] + [f"alpha beta gamma delta line {i}" for i in range(10)])
    rows = [(1, first, "a", 0), (2, "own\n" + first[5:] + "\ntail", "b", 0), (3, first[5:], "c", 0), (4, None, "d", 0), (5, "", "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, n_chars long")
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert out[1]["text"] == first and out[2]["text"] == "own\ntail" and out[2]["n_chars"] == 8 and out[2]["words"] == "b"
    assert out[3]["text"] == "" and out[4]["text"] is None and out[5]["text"] == ""
    assert {r["doc_id"] for r in linededup.dedup_lines(docs, gone=True).collect()} == {1, 2, 4, 5}


def test_rows_without_doc_id(spark):
    passage = "\n".join(f"alpha beta gamma delta epsilon line {i}" for i in range(10))
    other = passage.replace("alpha", "omega")
    rows = [(None, f"a\n{passage}"), (1, f"b\n{passage}"), (2, f"c\n{passage}"), (None, f"d\n{other}"), (None, f"e\n{other}"), (2, f"c\n{passage}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # the second of two equal rows repeats all of the first
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in linededup.dedup_lines(docs).collect())
    assert left[:2] == [(0, ""), (0, "a")] and left[4:] == [(1, f"b\n{passage}"), (2, ""), (2, "c")]
    assert left[2:4] in ([(0, "d"), (0, f"e\n{other}")], [(0, f"d\n{other}"), (0, "e")])
    runs = {(r["doc_id"], r["of_doc"]) for r in linededup.repeated_runs(docs).collect()}
    # a fingerprint may come first in document 2
    assert runs - {(None, 2), (2, 2)} == {(2, 1), (None, 1), (None, None)}


def test_one_doc_id_of_several_texts(spark):
    passage = "\n".join(f"alpha beta gamma delta epsilon line {i}" for i in range(10))
    rows = [(2, "a\n" * 3 + passage), (2, "b\nc\nd\ne\n" + passage + "\ntail"), (2, "x"), (5, passage), (1, "own")]
    out = sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert out == [(1, "own"), (2, "a\n" * 3 + passage), (2, "b\nc\nd\ne\ntail"), (2, "x"), (5, "")]


def test_documents_that_many_others_repeat(spark, monkeypatch):
    rows = _rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "first_line", "last_line", "of_doc", "of_line"]
    whole = sorted(map(tuple, linededup.repeated_runs(docs).select(*columns).collect()))
    monkeypatch.setattr(linededup, "MEETINGS", 2)
    assert sorted(map(tuple, linededup.repeated_runs(docs).select(*columns).collect())) == whole != []


def test_query_tells_what_is_left(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone: dict = {}
    rows = linededup.op9_line_dedup(spark, sf).collect()
    for r in rows:
        gone.setdefault(r["doc_id"], set()).update(range(r["first_line"], r["last_line"] + 1))
    for r in rows:
        left = "\n".join(x for i, x in enumerate(docs[r["doc_id"]].split("\n")) if i not in gone[r["doc_id"]])
        left = left if left.strip(" \n\t\r") else ""
        assert (r["left_chars"], r["left_crc32"]) == (len(left), zlib.crc32(left.encode()))
    assert rows


def test_empty(spark):
    assert linededup.repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
