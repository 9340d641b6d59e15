import numpy as np
import pyarrow as pa

from tidewell.llm import langid


def test_held_out_accuracy(spark):
    rows = langid.op1_language_id(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    sure = [r for r in rows if lang[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in sure) >= 0.9 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts_and_clashing_columns(spark, odd, none):
    rows, docs = odd
    net = langid.train([b"the house and the dog", b"das haus und der hund"] * 20, ["en", "de"] * 20, rounds=30)
    out = langid.predict(docs.withColumnRenamed("source", "score"), net)
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score"] and out.count() == len(rows)
    said = {r["text"]: r for r in out.collect()}
    for text in (None, "", " \t\n", "1 2 3 4 5 6"):
        assert (said[text]["lang_pred"], said[text]["score"]) == ("und", 0.0)
    assert langid.predict(none, net).count() == 0
    assert langid.fit(langid.labelled_documents(none)) is None
    assert langid.fit(langid.labelled_documents(docs), sample=50).labels == ["en"]
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def _small():
    return langid.train([b"aaaa bbbb cccc dddd", b"eeee ffff gggg hhhh"] * 20, ["a", "e"] * 20, rounds=60)


def test_gradients_are_finite_differences():
    net = _small()
    rng = np.random.default_rng(2)
    for x in (net.inputs, net.states, net.out, net.bias):
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.3
    langid._silence(net.inputs)
    at = rng.integers(97, 103, (12, 5)).astype(np.uint8)
    at[9:, 2] = 0
    goal, share = np.array([0, 1, 0, 1, 1]), np.array([1.0, 0.7])

    def loss():
        both = np.concatenate([langid._run(net, at, d) for d in (0, 1)], axis=1).astype(np.float64)
        logits = np.einsum("kh,thb->ktb", net.out, both) + net.bias[:, :, None]
        logits -= np.log(np.exp(logits).sum(axis=0))
        weight = (at != 0) * share[goal]
        return -(logits[goal, :, np.arange(5)].T * weight).sum() / weight.sum()

    grads = langid._gradients(net, at, goal, share)
    for x, g in zip((net.inputs, net.states, net.out, net.bias), grads, strict=True):
        for place in np.argwhere(np.abs(g) > np.abs(g).max() / 3)[:6]:
            place, step = tuple(place), 1e-2
            x[place] += step
            up = loss()
            x[place] -= 2 * step
            slope = (up - loss()) / (2 * step)
            x[place] += step
            assert abs(slope - g[place]) < 0.02 * np.abs(g).max()


def test_pooling_is_the_mean_over_positions():
    net = _small()
    text = "aaaa eeee bbbb " * 9 + "hh"
    data, total = text.encode(), np.zeros(2)
    for s in range(0, len(data), langid.WINDOW):
        at = np.frombuffer(data[s : s + langid.WINDOW], np.uint8)[:, None]
        both = np.concatenate([langid._run(net, at, d) for d in (0, 1)], axis=1)[:, :, 0]
        for state in both:
            p = np.exp(net.out @ state + net.bias[:, 0])
            total += p / p.sum()
    best, score = langid.document_scores(net, pa.array([text]))
    assert abs(score[0] - total.max() / len(data)) < 1e-4 and best[0] == total.argmax()


def test_every_position_counts_alike():
    net = _small()
    best, score = langid.document_scores(net, pa.array(["aaaa bbbb " * 5000 + "eeee", "eeee ffff", None]))
    assert [net.labels[i] for i in best[:2]] == ["a", "e"] and score[2] == 0.0
