"""Language identification by Bayesian fusion of evidence.

Four sources of evidence meet in one posterior per document:

* the text: byte-trigram likelihoods per language (a bounded labelled sample trains them),
  against a flat background that stands for text of no known language;
* the declared markup language: how often each true language is declared as what, a table
  counted over the whole corpus and smoothed;
* the address suffix and the host: priors smoothed hierarchically (corpus to suffix to
  host), from counts of what the texts alone say, by grouped aggregates over all rows.

Counts are whole numbers, so results do not depend on the order of partial sums.  A host
that holds a third of all rows is combined map-side and its join can be split by AQE.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import arrow_rows, shared_table
from missive.llm.words import slices
from missive.session import ship_package

SAMPLE = 1500        # training texts per language, about
MOST = 512           # declared languages at most (256 KB of table each in every task); more raise an error
BUCKETS = 1 << 16
STRENGTH = 20.0      # rows of pseudo-counts a parent level lends to its child
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[33:65] = np.where((np.arange(33, 65) >= 48) & (np.arange(33, 65) <= 57), 48, 33)   # digits alike, signs alike
_FOLD[91:97], _FOLD[123:127] = 33, 33


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte (the last two bytes have none)."""
    c = _FOLD[buf].astype(np.uint32)
    if c.size < 3:
        return np.zeros(0, np.uint32)
    key = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def train(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood table [bucket, language + background])."""
    counts: dict[str, np.ndarray] = {}
    for text, lang in zip(texts, langs):
        _count(counts, lang, np.frombuffer((text or "").encode(), np.uint8))
    return _tables(counts)


def _count(counts: dict[str, np.ndarray], lang: str, buf: np.ndarray) -> None:
    own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
    own += np.bincount(trigrams(buf), minlength=BUCKETS)


def _count_batches(batches):
    """(language, text) to the trigram counts of this task: (lang, bucket, n)."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for i, j, buf, off in slices(b.column(1)):
            for k in range(i, j):
                _count(counts, langs[k], buf[off[k - i]:off[k - i + 1]])
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                                         names=["lang", "bucket", "n"])


def _tables(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Log-likelihoods of every language's trigram counts, and the background's."""
    names, logs, seen = sorted(counts), [], np.zeros(BUCKETS)
    for name in names:
        own = counts[name].astype(np.float64)
        logs.append(np.log((own + 0.2) / (own.sum() + 0.2 * BUCKETS)).astype(np.float32))
        seen += own
    seen += 0.2
    flat = np.log((seen ** 0.25) / (seen ** 0.25).sum())          # background: nearly flat over trigrams
    return names, np.stack([*logs, flat.astype(np.float32)]).T


def log_likelihoods(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' log-likelihoods per text; a trigram has three bytes, so a third
    of it counts (the evidence of overlapping trigrams is not independent)."""
    out = np.zeros((off.size - 1, table.shape[1]))
    g = trigrams(buf)
    for k in range(table.shape[1]):
        run = np.concatenate(([0.0], np.cumsum(table[:, k][g], dtype=np.float64)))
        a, b = np.minimum(off[:-1], g.size), np.minimum(np.maximum(off[1:] - 2, off[:-1]), g.size)
        out[:, k] = (run[b] - run[a]) / 3
    return out


def _text_evidence(table: np.ndarray, with_text: bool):
    """(row, text, declared, suffix, host) to the same, with or without the text, and the
    relative log-likelihoods, the best language and the number of letters."""
    def run(batches):
        for b in batches:
            ll = np.zeros((b.num_rows, table.shape[1]))
            letters = np.zeros(b.num_rows, np.int64)
            for i, j, buf, off in slices(b.column(1)):
                ll[i:j] = log_likelihoods(buf, off, table)
                folded = _FOLD[buf]
                n = np.concatenate(([0], np.cumsum((folded >= 97) & (folded < 123) | (buf >= 128))))
                letters[i:j] = n[off[1:]] - n[off[:-1]]
            rel = np.round(ll - ll.max(1, keepdims=True), 6)
            off = np.arange(0, rel.size + 1, rel.shape[1], dtype=np.int32)
            names = [n for n in b.schema.names if with_text or n != "text"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [
                pa.ListArray.from_arrays(pa.array(off), pa.array(rel.ravel())), pa.array(rel.argmax(1).astype(np.int32)), pa.array(letters)],
                names=[*names, "ll", "best", "letters"])
    return run


def fit_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = SAMPLE,
                  usable: Column | None = None, most_languages: int = MOST):
    """Train every language of ``lang_col`` on about ``per_language`` labelled texts, whole (those
    whose id hash lies in the share of its rows that gives as many), in one scan for all
    languages.  Tasks count trigrams; at most 65,536 counts per language reach the driver.
    More than ``most_languages`` raise an error: none is left out."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows if usable is None else rows.where(usable)
    langs = rows.groupBy(lang_col).count().limit(most_languages + 1).collect()
    if len(langs) > most_languages:
        raise ValueError(f"{lang_col} declares more than {most_languages} languages: pass a larger most_languages, or clean the column")
    if not langs:
        return [], np.zeros((BUCKETS, 1), np.float32)
    ship_package(docs.sparkSession)
    upto = F.create_map(*[x for r in langs for x in (F.lit(r[0]), F.lit(int(min(1.0, per_language / r[1]) * (1 << 30)) * (1 << 33) - 1))])
    h = F.xxhash64(F.col(id_col).cast("long")).bitwiseAND(F.lit((1 << 63) - 1))
    picked = rows.where(h <= F.try_element_at(upto, F.col(lang_col)))
    counts = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count_batches, "lang string, bucket int, n long")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect()
    tables = {r[0]: np.zeros(BUCKETS, np.int64) for r in langs}
    for r in found:
        for bucket, n in r["c"]:
            tables[r["lang"]][bucket] = n
    return _tables(tables)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None,
             suffix: Column | None = None, host: Column | None = None, accept=None, least: float = 0.5,
             min_letters: int = 3, strength: float = STRENGTH, whole: bool = False) -> DataFrame:
    """Per row: id, ``language``, ``probability``, ``text_language`` (text alone), ``kept``.

    ``whole``: the rows kept, with the columns of ``docs``, instead; the texts' evidence is
    then computed again beside the rows, so that no text is stored or shuffled.

    ``declared``, ``suffix`` and ``host`` are expressions on the columns of ``docs``; a
    missing or null one is no evidence.  Kept: the most probable language is one of
    ``accept`` (default: all trained), at least ``least`` probable, and the text has
    ``min_letters`` letters; otherwise the row is rejected.  Null and empty texts have no
    letters: they get their prior and are rejected.  Repeated rows and null ids give a row
    each.  An empty table gives no row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    names, table = model
    labels = [*names, UNKNOWN]
    n = len(labels)
    known = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    declared_code = none if declared is None else F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    at = F.array_position(known, declared_code)
    carried = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(F.col(id_col)).alias("row"), F.struct(*carried).alias("all"), F.col(text_col).alias("text"),
                       F.when(declared_code.isNull() | (declared_code == ""), F.lit(None)).when(at > 0, (at - 1).cast("int")).otherwise(F.lit(n - 1)).alias("declared"),
                       (none if suffix is None else suffix).alias("suffix"), (none if host is None else host).alias("host"))

    def evidence(df: DataFrame, with_text: bool) -> DataFrame:
        kind = df.schema["row"].dataType.simpleString()
        return df.mapInArrow(_text_evidence(table, with_text), f"row {kind}, " + "text string, " * with_text +
                             "declared int, suffix string, host string, ll array<double>, best int, letters long")
    ev = shared_table(evidence(rows.drop("all"), False), "li-evidence")
    said = ev.where(F.col("letters") >= min_letters)

    # expressions grow with n, not with n x n: a corpus may declare hundreds of languages
    def counted(df, *by):
        g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.sum((F.col("best") == k).cast("long")).alias(f"n{k}") for k in range(n)])
        return g.select(*by, "total", F.array(*[F.col(f"n{k}") for k in range(n)]).alias("counts"))

    def smoothed(parent: Column) -> Column:
        return F.zip_with("counts", parent, lambda c, p: (c + F.lit(strength) * p) / (F.col("total") + F.lit(strength)))

    # corpus level: n numbers; suffix and host levels: tables joined on their keys
    overall = [int(x or 0) for x in counted(said).first()["counts"]]
    base = [(c + 1.0) / (sum(overall) + len(overall)) for c in overall]
    top = F.array(*[F.lit(p) for p in base])
    hosts = said.where("host IS NOT NULL OR suffix IS NOT NULL")
    by_suffix = counted(hosts.where("suffix IS NOT NULL"), "suffix")
    by_suffix = shared_table(by_suffix.select("suffix", smoothed(top).alias("of_suffix")), "li-suffix")
    by_host = counted(hosts.where("host IS NOT NULL").withColumn("of", F.coalesce("suffix", F.lit(""))), "host", "of")
    by_host = by_host.join(by_suffix.withColumnRenamed("suffix", "of"), "of", "left").withColumn("parent", F.coalesce("of_suffix", top))
    by_host = shared_table(by_host.select("host", "of", smoothed(F.col("parent")).alias("of_host")), "li-host")
    # how each language is declared: (language by text, declared) counts, smoothed; at most n x n numbers
    seen = np.full((n, n), 0.5)
    for r in said.where("declared IS NOT NULL").groupBy("best", "declared").count().collect():
        seen[r["best"], r["declared"]] += r["count"]
    trust = np.log(seen / seen.sum(1, keepdims=True))
    declared_ll = F.when(F.col("declared").isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(
        F.from_json(F.lit(json.dumps(trust.T.tolist())), "array<array<double>>")[F.coalesce("declared", F.lit(0))])      # folded to a constant
    out = evidence(rows.drop("row").withColumnRenamed("all", "row").select("row", "text", "declared", "suffix", "host"), True) if whole else ev
    if suffix is not None:
        out = out.join(by_suffix, "suffix", "left")
    if host is not None:
        out = out.withColumn("of", F.coalesce("suffix", F.lit(""))).join(by_host, ["host", "of"], "left")
    prior = F.coalesce(*[F.col(c) for c in ("of_host", "of_suffix") if c in out.columns], top)
    out = out.withColumn("prior", prior).withColumn("told", declared_ll)
    out = out.withColumn("z", F.zip_with(F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), "told", lambda a, b: a + b))
    out = out.withColumn("p", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    out = out.withColumn("pick", F.array_position("z", F.array_max("z")).cast("int") - 1)
    out = out.withColumn("probability", F.round(F.lit(1.0) / F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6))
    names_col = F.array(*[F.lit(x) for x in labels])
    allowed = list(names) if accept is None else list(accept)
    kept = (F.col("language").isin(allowed) if allowed else F.lit(False)) & (F.col("probability") >= least) & (F.col("letters") >= min_letters)
    out = out.withColumn("language", names_col[F.col("pick")])
    if whole:
        return out.where(F.coalesce(kept, F.lit(False))).select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
    return out.select("row.*", "language", "probability", names_col[F.col("best")].alias("text_language"), F.coalesce(kept, F.lit(False)).alias("kept"))


MARKUP_RE = r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)"


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(t, r"<[^>]*>|&#?\w+;", " ")
