"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from data import ODD, SCHEMA, corpus, frame
from missive.llm import near_dups, packing, quality_crf, quality_rules, substring_dedup, topk, toxicity, url_filters
from missive.llm.language_id import fit_languages, identify
from missive.llm.mixing import mixture

PAIRS = corpus(24) + ODD
N_ROWS, N_IDS = len(PAIRS), len({i for i, _ in PAIRS if i is not None})


def labels_of(spark, docs):
    return docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "CAST(doc_id % 3 = 0 AS INT) AS toxic").unionByName(
        spark.createDataFrame([(1, None, None), (None, 1, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int"))


OPS = {
    "mixture": (lambda s, d: mixture(d, max_epochs=1.2), None),
    "packing": (lambda s, d: packing.pack(d), None),
    "quality_rules": (lambda s, d: quality_rules.quality_rules(d), N_ROWS),
    "language_id": (lambda s, d: identify(d, fit_languages(d), declared=F.col("lang"), host=F.col("source")), N_ROWS),
    "substring_dedup": (lambda s, d: substring_dedup.substring_digest(d), N_IDS),
    "without_repeats": (lambda s, d: substring_dedup.without_repeats(d), N_IDS),
    "near_dups": (lambda s, d: near_dups.near_duplicates(d), N_ROWS),
    "toxicity": (lambda s, d: toxicity.toxicity(d, toxicity.fit_toxicity(d, labels_of(s, d), F.lit(True))), N_ROWS),
    "quality": (lambda s, d: quality_crf.quality(d, quality_crf.fit_quality(d, labels_of(s, d), F.lit(True))), N_ROWS),
}


@pytest.mark.parametrize("name", list(OPS))
def test_odd_rows_and_clashing_names(spark, name):
    run, rows = OPS[name]
    got = run(spark, frame(spark, PAIRS, extra=True)).collect()
    assert rows is None or len(got) == rows
    by = {r["doc_id"]: r for r in got}
    if name == "quality_rules":
        assert by[900]["n_words"] == 0 and by[900]["base_failed"] and not by[901]["kept"] and by[908]["word_chars"] == 100_000
    if name == "near_dups":
        assert by[900]["n_shingles"] == 0 and by[900]["component_id"] == 900 and by[900]["kept"]
        assert by[905]["component_id"] == 904 and by[None]["component_id"] is None and by[None]["kept"]
    if name == "substring_dedup":
        assert by[900]["n_words"] == 0 and by[907]["n_removed"] == 87
    if name == "packing":
        assert by[900]["length"] == 1 and sum(r["doc_id"] == 905 for r in got) == 2 and sum(r["doc_id"] == 908 and r["piece"] == 0 for r in got) == 1
    if name == "mixture":
        assert not {900, 901, 902} & set(by)
    if name == "language_id":
        assert not by[900]["kept"] and not by[901]["kept"]


@pytest.mark.parametrize("name", list(OPS))
def test_empty_table(spark, name):
    assert OPS[name][0](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)], SCHEMA)
    for name in ("packing", "quality_rules", "language_id", "toxicity", "quality", "near_dups"):
        OPS[name][0](spark, df).collect()


def test_other_empty_tables(spark):
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.expr("vec_id % 2 = 0")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.expr("vec_id % 2 = 0")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([(2, [1.0])], "vec_id long, embedding array<float>"), F.expr("vec_id % 2 = 0")).count() == 0
    none = spark.createDataFrame([], "key string, on_date date, listed boolean")
    caps = spark.createDataFrame([(1, "http://a.b/c", None), (None, None, None)], "page_id long, url string, fetched_on date")
    assert [r["kept"] for r in url_filters.url_filter(caps, none).collect()] == [True, True]
    assert url_filters.url_filter(caps.limit(0), none).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    for pairs in (PAIRS, []):
        docs = frame(spark, pairs, extra=True) if pairs else spark.createDataFrame([], SCHEMA)
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() == 0) == (not pairs)


def test_op7_merges_different_texts_of_one_id(spark, tmp_path):
    from missive.llm.queries import QUERIES
    (_, a), (_, b) = [p for p in corpus(12) if len(p[1] or "") > 200][:2]
    rows = [(1, a), (1, b + " and more words after it"), (2, a), (3, b + " and more words after it")]
    for k, order in enumerate((rows, rows[::-1])):
        frame(spark, order).coalesce(1).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        out = QUERIES["op7_near_dups"](spark, str(tmp_path / str(k))).collect()
        got = {r["doc_id"]: r["component_id"] for r in out}
        kept = 2 if len(a) < len(rows[1][1]) else 3                    # the shorter text is the document's
        assert len(out) == 3 and got == {1: 1, kept: 1, 5 - kept: 5 - kept}
