"""A corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all
but the last return the columns of ``documents``.  Between stages the rows are written as
Parquet under the shared checkpoint folder and read again, so a lost executor repeats at
most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import shared_table
from missive.llm.language_id import fit_languages, identify
from missive.llm.mixing import mixed_documents
from missive.llm.near_dups import without_near_duplicates
from missive.llm.packing import pack
from missive.llm.substring_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those the corpus declares, sure enough and with letters."""
    return identify(docs, fit_languages(docs), declared=F.col("lang"), host=F.col("source"), whole=True)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a five-word-shingle similarity of 0.8 or more."""
    return without_near_duplicates(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word passages that start earlier in the corpus."""
    return without_repeats(docs, window=20)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened as far as a quarter more of the rarest allows; every document with
    words is used at least once.  Only the use counts reach packing, which forms sequences
    from lengths alone: the mixture's (block, place) order is not kept."""
    return mixed_documents(docs, max_epochs=1.25, cover=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dups", near_dups), ("substring_dedup", substring_dedup),
          ("mixing", mixing), ("packing", packing)]

# Near-duplicate bands, the packing program and the trained language model have no SQL form;
# tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
