"""Small documents with copies, near copies, shared passages, nulls and odd shapes."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["".join(p) for p in __import__("itertools").product(["ba", "do", "ki", "lu", "me"], repeat=3)]


def sentences(rng, n):
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))).capitalize() + ".")
    return out


def corpus(n=60, seed=7):
    """(doc_id, text) pairs: fresh texts, copies, near copies and texts with a shared passage."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(45))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            text = rng.choice(texts)
        elif kind == 2 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 3:
            parts = sentences(rng, 4)
            parts.insert(rng.randrange(5), passage)
            text = "\n".join(parts)
        else:
            text = "\n".join(sentences(rng, rng.randint(2, 9)))
        texts.append(text)
    return list(enumerate(texts))


ODD = [
    (900, None), (901, ""), (902, " \t\n\x0b "), (903, "one"), (904, "one two"), (905, "ONE two"), (905, "ONE two"),
    (906, "naïve café ﬁ Σας   x\x85y 漢字 😀"), (None, "a row without an id " * 8), (907, "same words again " * 30),
    (908, "z" * 100_000), (909, "tie tie tie tie tie tie tie"),
]


def frame(spark, pairs, extra=False):
    rows = [(i, t, ("en", "de")[(i or 0) % 2], None if (i or 0) % 7 == 3 else f"s{(i or 0) % 4}", len(t or "")) for i, t in pairs]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:                                            # names that operators might use themselves
        for c in ("id", "n", "key", "hub", "block", "spans", "row", "label", "score", "epoch", "start", "length", "tokens", "place", "count", "ll"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def words(text):
    return (text or "").encode().split()
