"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.session import ensure_checkpoint_dir

# A word is a run of bytes other than ASCII blank, tab, LF, VT, FF and CR.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Runtime settings that hold inside the block only."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_table(df: DataFrame, name: str, **conf: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Lineage is cut (a lost executor re-reads files), and the shuffle files of the job go
    as soon as it ends, so the disk need is that of one step, not of all.  ``conf``:
    further settings (dots as two underscores) for this job.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    with settings(spark, **{CLEANUP.replace(".", "__"): "true"}, **conf):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Remove tables of ``shared_table`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if not files:
            continue
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/tables/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# A join of all texts with the few ids that need them: texts of other ids are dropped by a
# Bloom filter of the ids before the shuffle (it only ever lets too much pass).
ID_FILTER = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",       # the ids have no bound: one plan at every size
    "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "1MB",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1GB",
}


def texts_of(texts: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``texts`` joined with ``ids`` on ``key``.

    The ids grow with the corpus, so they are never broadcast: one plan at every size, a
    shuffled hash join that neither sorts the texts nor needs a bound on the ids.
    """
    return texts.join(ids.where(F.col(key) > F.lit(-(1 << 63))).hint("shuffle_hash"), key)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row, however often ``v`` is used."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words: one count of the first characters of words, no array is built."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def key60(*parts: Column) -> Column:
    """60-bit pseudo-random key of the parts; the same value in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def group_key(group: Column) -> Column:
    """Key of a group that may be null: never null itself, sorts null first, then UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def sqrt_buckets(n: int) -> int:
    """Power of two near sqrt(n): both the buckets and the rows of one bucket stay small."""
    return 1 << max(0, (max(1, n).bit_length() + 1) // 2)


def arrow_rows(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds: whole texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def hash_sample(rows: DataFrame, key: str, n_rows: int, k: int) -> DataFrame:
    """At most ``k`` rows: those with the smallest hashes of ``key`` among ``n_rows``.

    Rows above the hash that holds ``k`` rows (with six standard deviations to spare) are
    dropped where they are read, so tasks hand over a handful of rows each, however many
    tasks there are.
    """
    h = F.xxhash64(F.col(key).cast("long")).bitwiseAND(F.lit((1 << 63) - 1))
    share = min(1.0, (k + 6 * k ** 0.5 + 10) / max(n_rows, 1))
    near = rows.withColumn("__h", h).where(F.col("__h") <= F.lit(int(share * (1 << 30)) * (1 << 33) - 1))
    return near.orderBy("__h", *[c for c in rows.columns if c != key and rows.schema[c].dataType.typeName() in ("string", "integer")]).limit(k).drop("__h")


def one_row_per_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of one id are one document: keep one of them (the smallest text).

    Ids that occur once, nearly all of them, pass without a shuffle of their texts.
    """
    again = docs.groupBy(key).count().where("count > 1").select(key)
    if not again.take(1):
        return docs
    again = shared_table(again, "again")
    once = docs.join(again, key, "left_anti")
    text = F.col("text") if "text" in docs.columns else F.to_json(F.struct(*docs.columns))
    many = docs.join(again, key, "left_semi").withColumn("__size", F.struct(F.length(text), text))
    return once.unionByName(many.groupBy(key).agg(F.min_by(F.struct(*docs.columns), "__size").alias("__row"))
                            .select("__row.*").select(docs.columns))
