"""Bounded samples of labelled documents and a small logistic fit, shared by the scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import hash_sample, shared_table


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id's text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``per_class`` documents of each class (0 and 1).

    The documents with the smallest id hashes among the usable labelled ones are taken, so
    the sample is the same in every run and its size does not grow with the corpus.
    """
    one = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable)
           .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")))
    known = docs.select(id_col).distinct()
    one = shared_table(one.join(known, id_col, "left_semi"), "sample-labels")
    n = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    picked = [hash_sample(one.where(F.col("label") == c), id_col, n.get(c, 0), per_class) for c in (0, 1)]
    ids = shared_table(picked[0].union(picked[1]).select(F.col(id_col).alias("id"), "label"), "sample-ids")
    # at most 2 * per_class rows: a proven bound for the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return shared_table(rows, "sample")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression (a constant is a column of x)."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    if len(x) == 0:
        return w
    total = weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / total + ridge * w
        h = (x * (weight * p * (1 - p) / total)[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
