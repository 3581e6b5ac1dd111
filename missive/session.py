"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job needs for the semantics to hold (UTC wall clock, AQE for skew).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings for sessions this package builds itself (tests, bench).
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.driver.memory": "10g",
    # wide generated methods (validation CASE chains) must still be JIT-compiled
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    # checkpoint files of frames no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "missive") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**LOCAL_CONF, **REQUIRED_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read.  When it is
    unset on a local master (tests) a scratch folder is created and registered; on any other
    master that is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="missive-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if path.startswith("/") and not os.path.exists(path):
            os.makedirs(path, exist_ok=True)
        sc.setCheckpointDir(path)
    return path


_SHIPPED: dict[int, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``missive`` importable in Python workers (pandas folds reference it).

    The package is zipped once per driver process and added with ``addPyFile``, which
    distributes it to every executor, whatever the working directory is.
    """
    sc = spark.sparkContext
    key = id(sc)
    if key in _SHIPPED:
        return
    import zipfile
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="missive-py-"), "missive.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED[key] = out


def checkpoint_once(df):
    """Reliable checkpoint that computes ``df`` once: an RDD checkpoint re-runs its
    lineage to write unless the data is persisted, so persist, checkpoint, unpersist.
    Partitioning and order inside partitions are kept (needed by two-pass numbering)."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    c = p.checkpoint(eager=True)
    p.unpersist()
    return c


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it
    back: lineage is cut, a lost executor re-reads files instead of recomputing, and
    every branch that uses the frame scans it instead of re-deriving it."""
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
