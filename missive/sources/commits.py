"""Several tables written together: all of a batch's rows or none.

Each frame is staged in a folder of its own that no reader follows; one manifest file, renamed
into place, then names the folders of all of them.  Readers take their paths from the manifests
alone, so a batch whose job fails between two writes shows no row of any table, and a batch that
is run again after its manifest is there writes nothing.  Staged folders of failed runs stay
unread.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _publish(spark: SparkSession, base: str, version: str, folders: dict[str, str]) -> None:
    final, fs = _fs(spark, f"{base}/_commits/{version}.json")
    staged, _ = _fs(spark, f"{base}/_staged/{version}-{uuid.uuid4().hex[:12]}.json")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if not fs.rename(staged, final) and not fs.exists(final):
        raise OSError(f"manifest {final} could not be put in place")


def commit_tables(base: str, version: str, frames: dict[str, DataFrame]) -> bool:
    """Write ``frames`` (table name to rows) as one commit ``version`` of the tables under
    ``base``; false if that commit is there already, which then stays as it is."""
    spark = next(iter(frames.values())).sparkSession
    if _exists(spark, f"{base}/_commits/{version}.json"):
        return False
    folders = {}
    for table, rows in frames.items():
        folders[table] = f"{table}/commit={version}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{base}/{folders[table]}")
    _publish(spark, base, version, folders)
    return True


def committed(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """The rows of all commits of a table (None before the first commit).  The driver holds one
    path per commit."""
    if not _exists(spark, f"{base}/_commits"):
        return None
    folders = spark.read.schema(f"`{table}` string").json(f"{base}/_commits").where(f"`{table}` IS NOT NULL")
    paths = [f"{base}/{r[0]}" for r in folders.collect()]
    return spark.read.parquet(*paths) if paths else None
