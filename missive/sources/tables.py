"""Readers for the driver's Parquet tables (one file per table), batch or streaming."""

from __future__ import annotations

import contextlib
import contextvars
import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Tables read as streams inside ``streaming_tables(...)`` (empty = all batch).
_STREAMED: contextvars.ContextVar[frozenset] = contextvars.ContextVar("streamed", default=frozenset())
# Tables whose rows are dealt evenly inside ``dealt_tables(...)``.
_DEALT: contextvars.ContextVar[frozenset] = contextvars.ContextVar("dealt", default=frozenset())


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


@contextlib.contextmanager
def streaming_tables(*names: str):
    """Within the block, ``read_table`` returns a file-source stream for ``names``, so the
    same derivation code builds streaming inputs."""
    tok = _STREAMED.set(frozenset(names))
    try:
        yield
    finally:
        _STREAMED.reset(tok)


@contextlib.contextmanager
def dealt_tables(*names: str):
    """Within the block, ``read_table`` deals the rows of ``names`` evenly over the shuffle
    partitions: for work that costs far more per row than the scan, which a file of a few row
    groups would leave to a few tasks.  Only the columns that are read move."""
    tok = _DEALT.set(frozenset(names))
    try:
        yield
    finally:
        _DEALT.reset(tok)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain Parquet scan; column pruning and filter pushdown come from Catalyst.

    Streamed tables use the file source over the same folder, filtered to the table's
    file, with the schema of the batch table (no inference on a stream).
    """
    path = table_path(sf_dir, name)
    if name in _STREAMED.get():
        schema = spark.read.parquet(path).schema
        return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    table = spark.read.parquet(path)
    return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if name in _DEALT.get() else table
