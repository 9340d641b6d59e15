"""Language ID: a bidirectional gated recurrent network over UTF-8 bytes, trained in numpy.

The cell has one update gate, z = sigmoid(Wz x + Uz h), and a candidate
c = tanh(Wc x + Uc h); h' = (1 - z) h + z c (the light gated unit of Ravanelli
et al., 2018). One runs forward and one backward over windows of bytes; a
softmax over both states labels every position; a document's probabilities are
the mean over all its positions. Byte 0 pads: it leaves states as they are and
is not counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import mix, utf8_batches, word_hashes

#: Bytes of a window; states start at zero in each. All windows of a text are read.
WINDOW = 64
#: Windows that advance together.
LANES = 2048
HIDDEN = 8
#: About so many windows of the labelled texts, twice that at most, are gathered for training: chosen by hash from all
#: windows of all whole texts and shared among labels.
SAMPLE = 12_000
#: The pipeline rejects a document whose language is unknown or less sure than this.
LEAST_SCORE = 0.4


@dataclass
class Network:
    labels: list[str]
    inputs: np.ndarray  # 2 directions x 2H x 256: gate and candidate inputs of each byte
    states: np.ndarray  # 2 x 2H x H
    out: np.ndarray  # labels x 2H
    bias: np.ndarray  # labels x 1


def _silence(inputs: np.ndarray) -> None:
    """Byte 0 shuts the gate."""
    h = inputs.shape[1] // 2
    inputs[:, :h, 0] = -40.0
    inputs[:, h:, 0] = 0.0


def _half(x: np.ndarray) -> np.ndarray:
    """sigmoid, by tanh, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _run(net: Network, at: np.ndarray, direction: int) -> np.ndarray:
    """States (T, H, B) of one direction over byte windows (T, B)."""
    t, b = at.shape
    h = net.states.shape[2]
    seen = np.empty((t, h, b), np.float32)
    state = np.zeros((h, b), np.float32)
    inputs, states = net.inputs[direction], net.states[direction]
    both = np.empty((2 * h, b), np.float32)
    fed = np.empty((2 * h, b), np.float32)
    for i in range(t) if direction == 0 else range(t - 1, -1, -1):
        np.take(inputs, at[i], axis=1, out=fed, mode="clip")
        np.matmul(states, state, out=both)
        both += fed
        z, c = _half(both[:h]), both[h:]
        np.tanh(c, out=c)
        c -= state
        c *= z
        np.add(state, c, out=seen[i])
        state = seen[i]
    return seen


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=0, keepdims=True)
    return x


def window_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Sums (B, labels) over the positions of windows (B, T) of their label probabilities."""
    at = np.ascontiguousarray(windows.T)
    forward, backward = _run(net, at, 0), _run(net, at, 1)
    h = forward.shape[1]
    total = np.zeros((len(net.labels), at.shape[1]), np.float32)
    for i in range(at.shape[0]):
        p = _softmax(net.out[:, :h] @ forward[i] + net.out[:, h:] @ backward[i] + net.bias)
        p *= at[i] != 0
        total += p
    return total.T


def train(windows: list[bytes], labels: list[str], seed: int = 7, rounds: int = 420, lanes: int = 192) -> Network | None:
    """Backpropagation through time with Adam over windows of at most WINDOW bytes; None without any."""
    if not windows:
        return None
    names = sorted(set(labels))
    data = np.array([np.pad(np.frombuffer(w, np.uint8), (0, WINDOW - len(w))) for w in windows])
    goal = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    k, h = len(names), HIDDEN
    net = Network(
        names,
        (rng.standard_normal((2, 2 * h, 256)) * 0.3).astype(np.float32),
        (rng.standard_normal((2, 2 * h, h)) * 0.3).astype(np.float32),
        (rng.standard_normal((k, 2 * h)) * 0.3).astype(np.float32),
        np.zeros((k, 1), np.float32),
    )
    _silence(net.inputs)
    params = [net.inputs, net.states, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = len(goal) / (k * np.maximum(np.bincount(goal, minlength=k), 1))
    for step in range(1, rounds + 1):
        pick = rng.integers(0, len(goal), min(lanes, len(goal)))
        grads = _gradients(net, np.ascontiguousarray(data[pick].T), goal[pick], share)
        rate = 0.02 * (1 - step / (rounds + 1))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        _silence(net.inputs)
    return net


def _gradients(net: Network, at: np.ndarray, goal: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    t, b = at.shape
    h = net.states.shape[2]
    runs = [_run(net, at, 0), _run(net, at, 1)]
    live = (at != 0).astype(np.float32) * share[goal].astype(np.float32)
    live /= max(live.sum(), 1.0)
    both = np.concatenate(runs, axis=1)  # T, 2H, B
    logits = np.einsum("kh,thb->ktb", net.out, both, optimize=True) + net.bias[:, :, None]
    error = _softmax(logits.reshape(len(net.labels), -1)).reshape(logits.shape)
    error[goal, :, np.arange(b)] -= 1
    error *= live
    d_out = np.einsum("ktb,thb->kh", error, both, optimize=True)
    d_bias = error.sum(axis=(1, 2))[:, None]
    d_both = np.einsum("kh,ktb->thb", net.out, error, optimize=True)
    d_inputs, d_states = np.zeros_like(net.inputs), np.zeros_like(net.states)
    flat = at.ravel()
    for d in (0, 1):
        seen, inputs, states = runs[d], net.inputs[d], net.states[d]
        order = range(t - 1, -1, -1) if d == 0 else range(t)
        carried = np.zeros((h, b), np.float32)
        d_fed = np.empty((t, 2 * h, b), np.float32)
        for i in order:
            j = i - 1 if d == 0 else i + 1
            prior = seen[j] if 0 <= j < t else np.zeros((h, b), np.float32)
            both_in = inputs[:, at[i]] + states @ prior
            z, c = _half(both_in[:h]), np.tanh(both_in[h:])
            g = d_both[i, d * h : (d + 1) * h] + carried
            d_fed[i, :h] = g * (c - prior) * z * (1 - z)
            d_fed[i, h:] = g * z * (1 - c * c)
            d_states[d] += d_fed[i] @ prior.T
            carried = g * (1 - z) + states.T @ d_fed[i]
        rows = d_fed.transpose(1, 0, 2).reshape(2 * h, -1)
        for r in range(2 * h):
            d_inputs[d, r] = np.bincount(flat, rows[r], minlength=256)
    return [d_inputs, d_states, d_out.astype(np.float32), d_bias.astype(np.float32)]


def fit(rows: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on ``rows`` (key, text, label), of whose windows about ``sample``, twice that at most, reach the driver.

    Windows of all whole texts are counted by label first; each label's are then
    kept by a hash of text and place up to an equal share of the sample, so
    neither a hot label nor a rare one nor a long text crowds the others out. Rows
    without text or label teach nothing. A network has an output for each label,
    of which there must be few.
    """
    known = rows.filter("text is not null and text != '' and label is not null").select("label", "text")
    size = F.ceil(F.octet_length("text") / WINDOW)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.sum(size).alias("n")).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    chance = {label: min(1.0, each / n) for label, n in counts.items()}

    def windows(batches):
        import pyarrow as pa

        for batch in batches:
            labels = batch.column(0).to_pylist()
            out: list[tuple] = []
            for first, data, offsets in utf8_batches(batch.column(1)):
                hashes = word_hashes(data, offsets[:-1], offsets[1:])
                for r in range(len(offsets) - 1):
                    text = data[offsets[r] : offsets[r + 1]]
                    places = np.arange(-(-len(text) // WINDOW), dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        dice = mix(hashes[r] + places * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
                    for w in np.flatnonzero(dice < chance[labels[first + r]] * 2.0**53):
                        out.append((int(dice[w]), labels[first + r], text[w * WINDOW : (w + 1) * WINDOW].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)], ["dice", "label", "piece"])

    drawn = known.mapInArrow(windows, "dice long, label string, piece binary")
    got = drawn.distinct().orderBy("dice", "label", "piece").limit(2 * sample).collect()
    return train([bytes(r["piece"]) for r in got], [r["label"] for r in got])


def document_scores(net: Network, array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best label and its mean probability for each text of an Arrow string array (0, 0.0 where empty)."""
    n = len(array)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    for first, data, offsets in utf8_batches(array, LANES * WINDOW * 4):
        rows = len(offsets) - 1
        count = -(-np.diff(offsets) // WINDOW)
        owner = np.repeat(np.arange(rows), count)
        begins = np.repeat(offsets[:-1], count) + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        ends = np.minimum(begins + WINDOW, offsets[owner + 1])
        total = np.zeros((rows, len(net.labels)))
        live = np.zeros(rows)
        step = np.arange(WINDOW)
        for s in range(0, len(owner), LANES):
            at = begins[s : s + LANES, None] + step
            inside = at < ends[s : s + LANES, None]
            windows = data[np.minimum(at, len(data) - 1)] * inside
            np.add.at(total, owner[s : s + LANES], window_probabilities(net, windows))
            np.add.at(live, owner[s : s + LANES], (windows != 0).sum(axis=1))
        total /= np.maximum(live, 1)[:, None]
        best[first : first + rows] = total.argmax(axis=1)
        score[first : first + rows] = np.clip(total.max(axis=1), 0, 1)
    return best, score


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with its columns, then lang_pred and score (each replaced if there already).

    A text that is null or has no letter is `und` with score 0; so is every text
    if no network could be trained. Equal probabilities go to the label first in order.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*kept)
    if net is None:
        return base.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    fed = base.withColumn("__lettered", lettered)
    schema = base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def label(batches):
        import pyarrow as pa

        names = np.array(net.labels, dtype=object)
        for batch in batches:
            lettered = batch.column(batch.schema.get_field_index("__lettered")).to_numpy(zero_copy_only=False)
            best, score = document_scores(net, batch.column(batch.schema.get_field_index("text")))
            said = np.where(lettered.astype(bool), names[best], "und")
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(said, pa.string()), pa.array(np.where(lettered.astype(bool), score, 0.0))],
                names=[*kept, "lang_pred", "score"],
            )

    return fed.mapInArrow(label, schema)


def language_id(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Fit on ``labelled`` (key, text, label) and predict the language of every whole text of ``docs``."""
    return predict(docs, fit(labelled))


def labelled_documents(docs: DataFrame) -> DataFrame:
    """The rows to learn from: text and lang of documents whose crc32 of doc_id, mod 5, is not 0."""
    return docs.filter("lang is not null and crc32(cast(doc_id as string)) % 5 != 0").select(
        F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")
    )


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    from tidewell.llm.common import read

    docs = read(spark, sf_dir, "documents")
    net = fit(labelled_documents(docs))
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), net).drop("text")
