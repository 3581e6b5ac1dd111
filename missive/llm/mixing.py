"""Mixing sources to target weights by temperature, realised as budgeted blocks.

Native.  Shares of tokens per source are raised to an exponent a (1: as in the corpus,
0: all sources alike) and normalised.  The exponent is bisected to meet a target entropy
or a repetition limit; several steps are evaluated in each aggregate over the sources, and
only scalars reach the driver.  The weights become whole-token quotas, and each source's
stream (its documents in pseudo-random order, one permutation per epoch) is cut at its
quota and spread evenly over blocks, so that every block holds the sources in the target
weights; inside a block the documents are permuted.

Places in a stream are prefix sums in two steps (per bucket of the permutation key, then
inside the bucket) with about sqrt(n) buckets, so no window holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import drop_tables, key60, n_words_of, one_row_per_id, shared_table, sqrt_buckets
from missive.operators.ordering import global_row_number

LEVELS = 5          # bisection steps evaluated by one aggregate (2^5 - 1 candidates)
ROUNDS = 6          # aggregates: 30 bisection steps in all
REST = 1e9          # remainders of quotas are compared in billionths of a token


def source_shares(counts: DataFrame) -> DataFrame:
    """(source, n_tokens) rows to (source, tokens, share); sources without tokens get 0."""
    by = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = by.agg(F.sum("tokens").alias("total")).withColumn("total", F.coalesce("total", F.lit(0)))
    n = int(total.first()["total"])
    return shared_table(by.withColumn("share", F.lit(0.0) if n == 0 else F.col("tokens") / F.lit(float(n))), "shares")


def _power(a) -> Column:
    return F.when(F.col("share") > 0, F.pow("share", a if isinstance(a, Column) else F.lit(a))).otherwise(F.lit(0.0))


def _meets(shares: DataFrame, exponents: list[float], target_entropy, max_epochs, budget: int | None) -> list[bool]:
    """For each exponent: is its mixture at or beyond the flat side of the target?

    One aggregate over (source, exponent) rows; the exponents are data, not code, so every
    round runs the same compiled plan."""
    a, p = F.col("a"), F.col("p")
    rows = (shares.where("share > 0").withColumn("a", F.explode(F.array(*[F.lit(float(x)) for x in exponents]))).withColumn("p", _power(a))
            .groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * a * F.log("share")).alias("e"),
                              F.max(p / F.col("tokens")).alias("m"), F.min(p / F.col("tokens")).alias("l"))).collect()
    by = {r["a"]: r for r in rows}

    def met(x: float) -> bool:
        r = by.get(x)
        if r is None:
            return False
        if target_entropy is not None:
            return math.log(r["z"]) - r["e"] / r["z"] >= target_entropy
        return (r["m"] / r["l"] if budget is None else r["m"] / r["z"] * budget) > max_epochs
    return [met(float(x)) for x in exponents]


def mix_exponent(shares: DataFrame, budget: int | None, target_entropy: float | None = None, max_epochs: float | None = None) -> float:
    """Bisect the exponent in [0, 1].

    ``target_entropy`` (nats): the largest exponent whose entropy is at least the target.
    ``max_epochs``: the smallest exponent that repeats no source more often than that, within
    ``budget`` tokens (None: with the least repeated source used exactly once).
    Entropy and the highest repetition both fall as the exponent rises, so one predicate
    serves both.  A target that no exponent meets gives 0 (entropy) or 1 (repetition).
    """
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give either target_entropy or max_epochs")
    flat_lo, flat_hi = _meets(shares, [0.0, 1.0], target_entropy, max_epochs, budget)
    if not flat_lo:
        return 0.0
    if flat_hi:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (hi - lo) / (1 << LEVELS)
        mids = [lo + step * k for k in range(1, 1 << LEVELS)]
        flat = _meets(shares, mids, target_entropy, max_epochs, budget)
        last = max([k for k, ok in enumerate(flat, 1) if ok], default=0)
        lo, hi = lo + step * last, lo + step * (last + 1)
    return lo if target_entropy is not None else hi


def whole_quotas(shares: DataFrame, weight: Column, budget: int) -> DataFrame:
    """Adds ``quota``: the budget dealt by weight in whole tokens, which sum to the budget.

    Every source gets the whole part of its share; the tokens left go one each to the sources
    with the largest remainders (ties by name).  Sources are ranked by range partitioning, so
    their number has no bound."""
    exact = weight * F.lit(float(budget))
    q = shares.withColumn("quota", F.floor(exact).cast("long")).withColumn("rest", -F.floor((exact - F.floor(exact)) * F.lit(REST)).cast("long"))
    left = budget - int(q.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("t")).first()["t"])
    ranked = global_row_number(q, ["rest", "source"], out="nth")
    return ranked.withColumn("quota", F.col("quota") + F.when(F.col("nth") <= left, 1).otherwise(0)).drop("rest", "nth")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *,
            tokens: Column | None = None, budget: int | None = None, target_entropy: float | None = None,
            max_epochs: float | None = None, cover: bool = False, block_tokens: int = 1 << 20,
            seed: int = 42) -> DataFrame:
    """One row per use of a document: id, source, n_tokens, epoch, block, place.

    Tokens are whitespace words unless ``tokens`` gives an expression.  ``budget`` (default:
    all tokens of the input) is shared by the weights; a document is used while its start in
    its source's stream is below the quota.  ``cover``: the budget follows from the weights
    instead, so that every document is used at least once.  ``block`` numbers blocks of about
    ``block_tokens`` tokens, ``place`` the documents inside a block.

    A null source is a source of its own.  Null or empty texts have no token: they take no
    part.  Repeated rows count as often as they occur; an empty table gives no row.
    """
    n_tokens = n_words_of(F.col(text_col)) if tokens is None else tokens
    counts = shared_table(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                                      n_tokens.cast("long").alias("n_tokens")), "mix-counts")
    shares = source_shares(counts)
    row = counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    budget = int(row["t"]) if budget is None else int(budget)
    buckets = sqrt_buckets(int(row["n"]))
    exponent = mix_exponent(shares, None if cover else budget, target_entropy, max_epochs)
    r = shares.where("tokens > 0").agg(F.sum(_power(exponent)).alias("z"), F.max(F.col("tokens") / _power(exponent)).alias("need")).first()
    norm = r["z"] or 1.0
    if cover:
        budget = math.ceil((r["need"] or 0.0) * norm)
    blocks = max(1, -(-budget // block_tokens))
    quota = F.greatest("quota", "tokens") if cover else F.col("quota")
    plan = shared_table(whole_quotas(shares.where("tokens > 0"), _power(exponent) / F.lit(norm), budget)
                        .select("source", "tokens", quota.alias("quota")).where("quota > 0")
                        .withColumn("epochs", F.ceil(F.col("quota") / F.col("tokens")).cast("long")), "mix-plan")
    uses = (counts.where("n_tokens > 0").join(plan.select("source", "epochs"), "source")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).drop("epochs")
            .withColumn("key", key60(F.lit(seed), F.col("epoch"), F.col("id")))
            .withColumn("bucket", F.floor(F.col("key") / F.lit((1 << 60) // buckets)).cast("long")))
    uses = shared_table(uses, "mix-uses")
    per = uses.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = shared_table(per.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)))
                       .drop("bucket_tokens").join(plan, "source"), "mix-buckets")
    inside = (Window.partitionBy("source", "epoch", "bucket").orderBy("key", "id", "n_tokens")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (uses.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
              .join(per, ["source", "epoch", "bucket"])
              .withColumn("start", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("inner"))
              .where("start < quota")
              .withColumn("block", F.floor(F.col("start").cast("decimal(38,0)") * F.lit(blocks) / F.col("quota")).cast("long")))
    order = Window.partitionBy("block").orderBy("key", "source", "id", "n_tokens")
    out = placed.select(F.col("id").alias(id_col), "source", "n_tokens", "epoch", "block",
                        F.row_number().over(order).cast("long").alias("place"))
    out = shared_table(out, "mix")
    drop_tables(uses, per)
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each as often as the mixture uses it (columns as given).

    Rows of one id are one document.  The texts are shuffled once, to meet their counts.
    """
    docs = one_row_per_id(docs, id_col)
    uses = mixture(docs, id_col, **options).groupBy(id_col).agg(F.count("*").cast("int").alias("__uses"))
    return docs.join(shared_table(uses, "mix-times").hint("shuffle_hash"), id_col).withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__uses")))).select(docs.columns)
