"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are counts of its bytes and words and those of the
lines before and after it.  Line labels are not given, only document labels: lines of good
documents are good, and lines of bad documents start bad and are relabelled by the fit
itself while each bad document keeps its worst line bad.  The chain's weights (features,
start, transitions) are fitted by gradient steps on the conditional likelihood with
forward-backward over all sampled documents at once.  A document's quality is the mean of
its lines' marginals weighted by line length, mapped to a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import arrow_rows
from missive.llm.labelled import fit_logistic, labelled_sample, sigmoid
from missive.llm.quality_rules import STOP_WORDS
from missive.llm.words import find_words, runs, slices, word_hashes
from missive.session import ship_package

SAMPLE = 2000        # labelled documents per class that the field is fitted on
N_OWN = 12           # features of a line itself


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
    t[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    t[[ord(c) for c in "0123456789"]] = 3
    t[[ord(c) for c in "#*$%&<>|@^~=_\\{}[]"]] = 4
    t[[ord(c) for c in "!?"]] = 5
    t[[ord(c) for c in ".,;:'\"()-"]] = 6
    t[128:] = 7
    return t


_CLASS = _classes()
_KINDS = 8


def _hash_words(words) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = find_words(buf, np.array([0, buf.size]))
    return np.unique(word_hashes(buf, s, e, lower=True))


_STOPS = _hash_words(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))


def line_features(buf: np.ndarray, off: np.ndarray):
    """Features of all lines that hold a word: (x, weight, lines per text)."""
    starts, ends, first = find_words(buf, off)
    n_docs = off.size - 1
    if starts.size == 0:
        return np.zeros((0, 3 * N_OWN + 1)), np.zeros(0), np.zeros(n_docs, np.int64)
    breaks = np.cumsum(buf == 10)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    line = breaks[starts] + doc                           # texts are lines of their own
    new = np.concatenate(([True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])))
    head = np.flatnonzero(new)
    line_no = np.cumsum(new) - 1
    n_lines = head.size
    words = np.diff(np.concatenate((head, [starts.size])))
    a, b = starts[head], ends[np.concatenate((head[1:], [starts.size])) - 1]
    cls = _CLASS[buf]
    counts = np.empty((n_lines, _KINDS))
    for k in range(_KINDS):
        hit = np.concatenate(([0], np.cumsum(cls == k)))
        counts[:, k] = hit[b] - hit[a]
    size = np.maximum((b - a), 1).astype(float)
    h = word_hashes(buf, starts, ends, lower=True)
    at = np.minimum(np.searchsorted(_STOPS, h), _STOPS.size - 1)
    stop = np.bincount(line_no, weights=_STOPS[at] == h, minlength=n_lines) / words
    rep = np.zeros(h.size)
    three = runs(h, 3)
    for f, t in zip(first[:-1], first[1:]):               # 3-word runs that the text repeats
        if t - f >= 4:
            own = three[f:t - 2]
            _, inv, c = np.unique(own, return_inverse=True, return_counts=True)
            rep[f:t - 2] = c[inv] > 1
    same = np.concatenate(([0.0], (h[1:] == h[:-1]).astype(float)))
    letters = counts[:, 1] + counts[:, 2] + counts[:, 7]
    own = np.column_stack([
        np.log1p(words) / 5, (b - a) / words / 10, np.minimum(words, 3) / 3,
        counts[:, 2] / np.maximum(letters, 1), counts[:, 3] / size, np.minimum(counts[:, 4] / words, 3), np.minimum(counts[:, 5] / words, 3),
        np.minimum(counts[:, 6] / words, 3), letters / size, stop,
        np.bincount(line_no, weights=rep, minlength=n_lines) / words, np.bincount(line_no, weights=same, minlength=n_lines) / words])
    per = np.bincount(doc[head], minlength=n_docs)
    start = np.concatenate(([0], np.cumsum(per)[:-1]))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[start[per > 0]] = 0
    after[(start + per - 1)[per > 0]] = 0
    return np.column_stack([np.ones(n_lines), own, before, after]), words.astype(float), per


def marginals(score: np.ndarray, per: np.ndarray, start: float, trans: np.ndarray):
    """Forward-backward of all chains at once.

    ``score``: log-odds of good per line; ``trans``: log weights [before, after].  Chains
    are walked side by side, the longest first.  Returns P(good) per line, the pair
    marginals summed over all chains and the log normalisers' sum.
    """
    n = len(per)
    order = np.argsort(-per, kind="stable")
    size = per[order]
    at = (np.cumsum(per) - per)[order]
    top = int(size[0]) if n else 0
    live = np.searchsorted(-size, -np.arange(1, top + 1), "right")     # chains with more than t lines
    t01 = np.exp(trans)
    alpha = np.zeros((score.size, 2))
    scale = np.ones(score.size)
    emit = np.column_stack([np.ones(score.size), np.exp(np.clip(score, -30, 30))])
    cur = None
    for t in range(top):
        k = live[t]
        rows = at[:k] + t
        cur = emit[rows] * (np.array([1.0, np.exp(start)]) if t == 0 else cur[:k] @ t01)
        z = cur.sum(1)
        cur = cur / z[:, None]
        alpha[rows], scale[rows] = cur, z
    good, pair = np.zeros(score.size), np.zeros((2, 2))
    beta = np.ones((n, 2))
    for t in range(top - 1, -1, -1):
        k = live[t]
        rows = at[:k] + t
        p = alpha[rows] * beta[:k]
        good[rows] = p[:, 1] / p.sum(1)
        if t:
            out = emit[rows] * beta[:k] / scale[rows][:, None]
            pair += (alpha[rows - 1][:, :, None] * t01[None] * out[:, None, :]).sum(0)
            beta[:k] = out @ t01.T
    return good, pair, float(np.log(scale).sum())


def _line_fit(x, y, weight):
    return fit_logistic(x, y, ridge=1e-3, steps=25, weight=weight)


def fit_field(x: np.ndarray, words: np.ndarray, per: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 60):
    """Fit (feature weights, start, transitions) and the curve from line features of labelled documents."""
    doc = np.repeat(np.arange(per.size), per)
    y = label[doc].astype(float)
    weight = np.ones(len(x))
    for c in (0, 1):                                       # both classes weigh alike
        n = (label[doc] == c).sum()
        weight[label[doc] == c] = len(x) / (2 * max(n, 1))
    w = _line_fit(x, y, weight)
    for _ in range(rounds):                                # which lines make a bad document bad
        z = x @ w
        y = np.where(label[doc] == 1, 1.0, (z > 0).astype(float))
        worst = np.full(per.size, np.inf)
        np.minimum.at(worst, doc, z)
        y[(label[doc] == 0) & (z <= worst[doc])] = 0.0
        w = _line_fit(x, y, weight)
    start, trans = 0.0, np.zeros((2, 2))
    inside = np.concatenate(([False], doc[1:] == doc[:-1])) if len(x) else np.zeros(0, bool)
    yi = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (yi[:-1][inside[1:]], yi[1:][inside[1:]]), 1)
    heads = yi[~inside].mean() if len(x) else 0.5
    total = max(len(x), 1)
    rate, m_w, v_w = 0.1, np.zeros(w.size + 5), np.zeros(w.size + 5)
    for k in range(1, steps + 1):                          # ascent on the conditional likelihood
        good, pair, _ = marginals(x @ w, per, start, trans)
        g = np.concatenate([x.T @ (y - good) / total - 1e-3 * w, [(yi[~inside] - good[~inside]).sum() / total],
                            ((seen - pair) / total - 1e-3 * trans).ravel()])
        m_w, v_w = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g
        step = rate * (m_w / (1 - 0.9 ** k)) / (np.sqrt(v_w / (1 - 0.99 ** k)) + 1e-6)
        w, start, trans = w + step[:w.size], start + step[w.size], trans + step[w.size + 1:].reshape(2, 2)
    model = (w, float(start), trans)
    q = document_quality(x, words, per, model)
    return model, fit_logistic(curve(q, np.bincount(doc, weights=words, minlength=per.size)), label.astype(float), ridge=1e-4)


def document_quality(x, words, per, model) -> np.ndarray:
    """Length-weighted mean of the lines' P(good); a text without a line gets 0."""
    w, start, trans = model
    doc = np.repeat(np.arange(per.size), per)
    good, _, _ = marginals(x @ w, per, start, trans)
    return np.bincount(doc, weights=good * words, minlength=per.size) / np.maximum(np.bincount(doc, weights=words, minlength=per.size), 1)


def curve(q: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(q.size), q, q * q, np.minimum(np.log1p(words), 5) / 5])


def _scores(model, weights):
    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            quality = np.zeros(b.num_rows)
            lines = np.zeros(b.num_rows, np.int64)
            for i, j, buf, off in slices(b.column(1)):
                x, words, per = line_features(buf, off)
                q = document_quality(x, words, per, model)
                n = np.bincount(np.repeat(np.arange(per.size), per), weights=words, minlength=per.size)
                out[i:j], quality[i:j], lines[i:j] = sigmoid(curve(q, n) @ weights), q, per
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(quality), pa.array(lines)], names=["id", "score", "line_quality", "n_lines"])
    return run


def _features(batches):
    for b in batches:
        for i, j, buf, off in slices(b.column(1)):
            x, words, per = line_features(buf, off)
            doc = np.repeat(np.arange(per.size), per)
            edge = np.concatenate(([0], np.cumsum(per)))
            for d in range(i, j):
                own = slice(edge[d - i], edge[d - i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([b.column(2)[d].as_py()], pa.int32()), pa.array([x[own].ravel().tolist()], pa.list_(pa.float64())),
                                                  pa.array([words[own].tolist()], pa.list_(pa.float64()))], names=["label", "x", "words"])


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", per_class: int = SAMPLE):
    """Fit on at most ``per_class`` labelled documents of each class; only their line
    features reach the driver.  The curve sees the classes as often as they occur."""
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    rows = labelled_sample(docs, labels, label_col, usable, per_class, id_col, text_col)
    t = rows.select(F.col("id").cast("long"), "text", "label").mapInArrow(_features, "label int, x array<double>, words array<double>").toArrow()
    label = t["label"].to_numpy().astype(int)
    words = [np.array(w) for w in t["words"].to_pylist()]
    per = np.array([w.size for w in words], np.int64)
    x = np.concatenate([np.array(v) for v in t["x"].to_pylist()] + [np.zeros(0)]).reshape(-1, 3 * N_OWN + 1)
    return fit_field(x, np.concatenate(words + [np.zeros(0)]), per, label)


def quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` in 0..1, ``line_quality``, ``n_lines`` (lines with a word).
    Null and empty texts have no line and quality 0; repeated rows and null ids give a row each."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scores(*model), "id long, score double, line_quality double, n_lines long")
    return out.withColumnRenamed("id", id_col)
