"""Substring de-duplication against an index of all text.

It stands for greedy relative Lempel-Ziv factoring, but no factor is formed or extended:
the duplicate spans are the words of all windows that occur earlier, found by equality of
hashed blocks and windows, which aggregates answer without a sequential pass.

Every document is cut in reference blocks: content-defined anchors (the smallest hash of
the 4-word runs inside each 20-word window) pick about one word in nine, and a block is
the run of windows that share an anchor.  Equal windows always pick the same anchor, so
the index of blocks by anchor meets every repeated passage at any alignment.

Blocks are then compared with those of everything that starts before them: a block whose
whole content occurs earlier is a duplicate as a whole; one that shares only its anchor with
an earlier one is compared window by window, so a span ends exactly where one more word would
leave what occurs earlier.  Everything outside such windows stays literal.

Only anchors that occur twice or more leave the first aggregate, and the windows of a
block are only written out where its anchor has several contents; occurrences are never
paired (each content keeps its first place, by aggregates).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import ID_FILTER, arrow_rows, drop_tables, one_row_per_id, shared_table, texts_of
from missive.llm.words import find_words, lists, long_runs, mix, runs, signed, slices, word_hashes
from missive.session import ship_package

WINDOW = 20
ANCHOR_WORDS = 4


def blocks_of(h: np.ndarray, window: int, anchor: int):
    """Blocks of one text's word hashes: anchor hash, first and last window start.

    Each window's anchor is the leftmost smallest ``anchor``-word run inside it; windows in
    a row with the same anchor form a block.
    """
    x = runs(h, anchor)
    span = window - anchor + 1                 # runs per window
    best = np.arange(x.size)
    size = 1
    while size * 2 <= span:
        a, b = best[:best.size - size], best[size:]
        best = np.where(x[a] <= x[b], a, b)
        size *= 2
    if size < span:
        a, b = best[:best.size - (span - size)], best[span - size:]
        best = np.where(x[a] <= x[b], a, b)
    if best.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), best
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    last = np.concatenate((first[1:], [best.size])) - 1
    return x[best[first]], first, last, best[first]


def _sums(h: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hash of a block's whole content (its words and where its anchor lies in them).

    Words are weighted by their place from the block's start, so equal contents at
    different places of texts agree."""
    length = last - first + window
    owner = np.repeat(np.arange(first.size), length)
    place = np.arange(owner.size) - np.repeat(np.cumsum(length) - length, length)
    part = mix(h[first[owner] + place] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    edge = np.concatenate(([0], np.cumsum(length)[:-1]))
    total = np.add.reduceat(part, edge) if first.size else np.zeros(0, np.uint64)
    return mix(total ^ mix((at - first).astype(np.uint64) + length.astype(np.uint64) * np.uint64(1 << 32)))


def _index(window: int, anchor: int):
    """(id, text) to (id, n_words, anchors, contents, firsts, lasts)."""
    def run(batches):
        for batch in batches:
            for i, j, buf, off in slices(batch.column(1)):
                starts, ends, word = find_words(buf, off)
                h = word_hashes(buf, starts, ends)
                got = []
                for a, b in zip(word[:-1], word[1:]):
                    own = h[a:b]
                    if own.size < window:
                        got.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        continue
                    key, first, last, at = blocks_of(own, window, anchor)
                    got.append((key, _sums(own, first, last, at, window), first, last))
                n = np.array([x[0].size for x in got], np.int64)
                key, con, first, last = (np.concatenate([x[c] for x in got]) for c in range(4))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[i:j], pa.array(np.diff(word)), lists(signed(key), n, pa.int64()), lists(signed(con), n, pa.int64()),
                    lists(first.astype(np.int32), n, pa.int32()), lists(last.astype(np.int32), n, pa.int32())],
                    names=["id", "n_words", "anchors", "contents", "firsts", "lasts"])
    return run


def _windows(window: int):
    """(id, text, spans of window starts) to one row per window: two hashes and its place."""
    def run(batches):
        for batch in batches:
            ids, spans = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, buf, off in slices(batch.column(1)):
                starts, ends, word = find_words(buf, off)
                h = word_hashes(buf, starts, ends)
                for d in range(i, j):
                    own = h[word[d - i]:word[d - i + 1]]
                    at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans[d]])
                    one, two = long_runs(own, window, 0x1234567), long_runs(own, window, 0x7654321)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[d]] * at.size, pa.int64()), pa.array(at.astype(np.int32)),
                        pa.array(signed(one[at])), pa.array(signed(two[at]))], names=["id", "at", "h1", "h2"])
    return run


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR_WORDS) -> tuple[DataFrame, DataFrame]:
    """(counts, spans): (id, n_words), and (id, first, last) of runs of window starts whose
    words also start earlier (smaller id, or same id and earlier place)."""
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = shared_table(texts.mapInArrow(_index(window, anchor), "id long, n_words long, anchors array<long>, contents array<long>,"
                                          " firsts array<int>, lasts array<int>"), "sd-index")
    again = shared_table(index.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor"), "sd-again")
    blocks = index.select("id", F.explode(F.arrays_zip(
        F.col("anchors").alias("anchor"), F.col("contents").alias("content"), F.col("firsts").alias("first"),
        F.col("lasts").alias("last"))).alias("b")).select("id", "b.*")
    hits = shared_table(blocks.join(again, "anchor", "left_semi"), "sd-hits")
    counts = shared_table(index.select("id", "n_words"), "sd-counts")
    drop_tables(index, again)
    # the first place of each content; anchors with several contents are looked into
    place = F.struct("id", "first")
    contents = shared_table(hits.groupBy("anchor", "content").agg(F.min(place).alias("place"), F.count("*").alias("c")), "sd-contents")
    several = shared_table(contents.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "sd-several")
    later = (hits.join(contents.where("c > 1").select("anchor", "content", "place"), ["anchor", "content"])
             .where(F.struct("id", "first") > F.col("place")).select("id", "first", "last"))
    later = shared_table(later, "sd-later")
    firsts = (contents.join(several, "anchor", "left_semi")
              .select("anchor", "content", F.col("place.id").alias("id"), F.col("place.first").alias("first"))
              .join(hits, ["anchor", "content", "id", "first"]).select("id", "first", "last").distinct())
    asked = shared_table(firsts.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "sd-asked")
    drop_tables(hits, contents, several)
    seen = texts_of(texts, asked).select("id", "text", "spans").mapInArrow(_windows(window), "id long, at int, h1 long, h2 long")
    seen = shared_table(seen, "sd-windows", **ID_FILTER)
    first = shared_table(seen.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("place"), F.count("*").alias("c")).where("c > 1")
                         .select("h1", "h2", "place"), "sd-first")
    single = (seen.join(first, ["h1", "h2"]).where(F.struct("id", "at") > F.col("place"))
              .select("id", F.col("at").alias("first"), F.col("at").alias("last")))
    spans = shared_table(later.unionByName(single), "sd-spans")
    drop_tables(later, asked, seen, first)
    return counts, spans


def _cover(n: int, spans, window: int) -> np.ndarray:
    gone = np.zeros(n + 1, np.int32)
    if spans:
        a = np.array([s["first"] for s in spans])
        b = np.array([s["last"] for s in spans]) + window
        np.add.at(gone, a, 1)
        np.add.at(gone, np.minimum(b, n), -1)
    return np.cumsum(gone[:n]) > 0


def _digest(window: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if spans:
                    words = [w for w, x in zip(words, _cover(n, spans, window).tolist()) if not x]
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                             names=["id", "n_words", "n_removed", "kept_sha256"])
    return run


def cut(text: str, spans, window: int) -> str:
    """The text without the words of its spans (and the blanks after them)."""
    raw = text.encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, np.uint8)
    starts, ends, _ = find_words(buf, np.array([0, buf.size]))
    gone = _cover(starts.size, spans, window)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    parts, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        parts.append(raw[at:starts[a]])
        at = int(starts[b]) if b < starts.size else int(ends[-1])
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _cleaned(window: int):
    def run(batches):
        for batch in batches:
            row, text, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "text", "spans"))
            out = [t if not s or t is None else cut(t, s, window) for t, s in zip(text.to_pylist(), spans.to_pylist())]
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.string())], names=["row", "text"])
    return run


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with an ``id`` joined with the list of their spans (null: none)."""
    by = shared_table(spans.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "sd-by-doc")
    return rows.join(by.hint("merge"), "id", "left")


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (kept words joined by one blank).

    Words are compared unchanged.  Null and empty texts have no words.  Rows of one id are
    one document (they give one row); rows without an id go.  Texts shorter than a window
    lose nothing.
    """
    docs = one_row_per_id(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text")), id_col)
    _, spans = duplicate_spans(docs, id_col, "text", window)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    out = _with_spans(rows, spans).select("id", "text", "spans").mapInArrow(_digest(window), "id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with duplicate spans cut out of their texts; other columns as given
    (``n_chars`` follows the text).  A text without repeats stays byte for byte; a text
    that is all repeats becomes empty and its row stays.  Rows without an id go."""
    docs = one_row_per_id(docs.where(F.col(id_col).isNotNull()), id_col)
    _, spans = duplicate_spans(docs, id_col, text_col, window)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = _with_spans(rows, spans).select("row", "text", "spans").mapInArrow(_cleaned(window), f"row {kind}, text string")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.length("text").cast("long").alias(c) if c == "n_chars"
                        else F.col("row")[c].alias(c) for c in docs.columns])
