"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Texts are folded first (case, compatibility forms, look-alike letters of other scripts,
digits and signs that stand for letters inside a word), so one entry meets all spellings.
The lexicon holds whole words and word beginnings, with weights learned as log-odds on a
bounded sample of labelled documents; of the entries that match one word the heaviest
counts.  Hits inside an exception phrase do not count.  The sum is normalised by the
text's length and mapped to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import arrow_rows
from missive.llm.labelled import fit_logistic, labelled_sample, sigmoid
from missive.session import ship_package

SAMPLE = 3000        # labelled documents per class that the lexicon and the curve are fitted on
ENTRIES = 3000       # lexicon entries at most

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "т": "t", "у": "y", "х": "x", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
    "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish", "class clown", "sore loser award",
              "stupid question", "scum of pond", "pond scum")

_FOLD = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(DIGITS)
# a word that holds letters and stand-ins, with a letter after the stand-in: "1diot", "l0ser", "id!ot"
_MIXED = re.compile(r"(?=[^\s]*[^\W\d_])(?<![^\s\"'(\[])(?:[^\W_]|[@$!|+])*[013457890@$!|+][^\W\d_](?:[^\W_]|[@$!|+])*")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words, one blank before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _MIXED.sub(lambda m: m.group().translate(_SIGNS), text)
    text = _GAP.sub(" ", text).strip()
    return f" {text} " if text else " "


def _beginnings(word: str):
    yield " " + word + " "
    for n in range(4, min(len(word), 9)):
        yield " " + word[:n]


def learn_lexicon(rows, entries: int = ENTRIES, support: int = 6, least: float = 1.5) -> dict[str, float]:
    """(label, distinct words) of documents to entries with log-odds weights.

    An entry needs ``support`` toxic documents (one in sixty, but three, where fewer
    than that are labelled); a longer one is kept only where it says
    clearly more than the beginnings it contains.
    """
    pos, neg, n_pos, n_neg = Counter(), Counter(), 0, 0
    support = min(support, max(3, sum(label for label, _ in rows) // 60))
    toxic_words = Counter()
    for label, words in rows:
        if label:
            toxic_words.update(set(words))
    wanted = Counter()
    for w, c in toxic_words.items():
        for g in set(_beginnings(w)):
            wanted[g] += c
    wanted = {g for g, c in wanted.items() if c >= support}
    for label, words in rows:
        found = {g for w in words for g in _beginnings(w) if g in wanted}
        (pos if label else neg).update(found)
        n_pos, n_neg = n_pos + label, n_neg + 1 - label
    weight = {}
    for g in sorted(wanted, key=lambda g: (len(g), g)):
        p, q = pos[g], neg[g]
        if p < support:
            continue
        w = math.log((p + 0.5) / (n_pos + 1)) - math.log((q + 0.5) / (n_neg + 1))
        shorter = max((weight[g[:n]] for n in range(5, len(g)) if g[:n] in weight), default=0.0)
        if w >= least and w >= shorter + 0.5:
            weight[g] = w
    top = sorted(weight.items(), key=lambda kv: (-pos[kv[0]] * kv[1], kv[0]))[:entries]
    return dict(top)


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick
        self.words = ahocorasick.Automaton()
        for g, w in lexicon.items():
            self.words.add_word(g, (len(g), w))
        for g in exceptions:
            g = fold(g)
            if g not in lexicon:
                self.words.add_word(g, (len(g), None))
        self.empty = not len(self.words)
        if not self.empty:
            self.words.make_automaton()

    def measure(self, text: str) -> tuple[float, int, int]:
        """Sum of the weights (heaviest entry per word), words hit, words."""
        folded = fold(text)
        n = folded.count(" ") - 1
        if self.empty or n <= 0:
            return 0.0, 0, max(n, 0)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.words.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif best.get(start, 0.0) < weight:
                best[start] = weight
        for a, b in spared:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return sum(best.values()), len(best), n


def _distinct_words(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array([sorted(set(fold(t or "").split())) for t in b.column(1).to_pylist()], pa.list_(pa.string()))],
                                         names=["label", "words"])


def curve(total: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns of the calibration: constant, weight and weight per length (long texts hold
    chance hits of weak entries in proportion to their length)."""
    n = np.maximum(words, 1)
    return np.stack([np.ones(len(n)), np.log1p(total), np.log1p(100 * total / n), np.log1p(hits), np.log1p(n) / 5], axis=1)


def _measures(lexicon):
    def run(batches):
        m = Matcher(lexicon)
        for b in batches:
            r = [m.measure(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)] + [pa.array([float(x[c]) for x in r]) for c in range(3)],
                                             names=["id", "label", "total", "hits", "words"])
    return run


def _scores(lexicon, weights):
    def run(batches):
        m = Matcher(lexicon)
        for b in batches:
            r = np.array([m.measure(t or "") for t in b.column(1).to_pylist()], float).reshape(-1, 3)
            p = sigmoid(curve(r[:, 0], r[:, 1], r[:, 2]) @ weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(r[:, 1].astype(np.int64)), pa.array(r[:, 2].astype(np.int64))],
                                             names=["id", "score", "n_hits", "n_words"])
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", per_class: int = SAMPLE):
    """(lexicon, curve weights) from at most ``per_class`` labelled documents of each class."""
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    rows = labelled_sample(docs, labels, label_col, usable, per_class, id_col, text_col).select(F.col("id").cast("long"), "text", "label")
    seen = rows.mapInArrow(_distinct_words, "label int, words array<string>").toArrow()
    lexicon = learn_lexicon(list(zip(seen["label"].to_pylist(), seen["words"].to_pylist())))
    m = rows.mapInArrow(_measures(lexicon), "id long, label int, total double, hits double, words double").toPandas()
    # classes are sampled alike; the curve counts them as often as they occur
    share = labels.where(usable & F.col(label_col).isin(0, 1)).agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()["p"] or 0.5
    y = m["label"].to_numpy(float)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    weight = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    return lexicon, fit_logistic(curve(m["total"].to_numpy(), m["hits"].to_numpy(), m["words"].to_numpy()), y, weight=weight)


def toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` in 0..1, ``n_hits``, ``n_words``.  Null and empty texts hold no
    hit and get the score of that; repeated rows and null ids give a row each."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scores(*model), "id long, score double, n_hits long, n_words long")
    return out.withColumnRenamed("id", id_col)
