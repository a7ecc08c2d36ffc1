"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. Sizes for the shuffle are left to AQE: at
# cluster scale `spark.sql.shuffle.partitions` is set by the deployment and
# AQE coalesces small partitions / splits skewed ones at runtime.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": f"{8 << 20}b",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "quarry",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


#: Bytes in one Arrow batch that a Python worker gets: its memory follows this, not the length of texts.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Settings every query relies on when it runs in a session built elsewhere (the
    caller's): UTC session time zone (timestamps are naive UTC in the data), bounded
    Arrow batches, the checkpoint folder, and the package importable by Python workers."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batch, None) != f"{BATCH_BYTES}b":
        spark.conf.set(batch, f"{BATCH_BYTES}b")
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (UDFs, mapInPandas) by shipping it
    as a zip with ``addPyFile``; once per SparkContext."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-code-")
    archive = shutil.make_archive(os.path.join(out, "quarry"), "zip", os.path.dirname(pkg), "quarry")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a scratch
    folder is set for a single-JVM session (``local``) only: on a cluster every executor
    would write to a disk of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df):
    """Cut the lineage of a DataFrame that several outputs read: write it once as a
    Parquet table under the shared ``spark.checkpoint.dir`` and read it back. The
    files survive executor loss (unlike a local checkpoint) and stay columnar."""
    return _written(df, df.write)


def hold(df, keep: bool = False):
    """``materialize`` where disk is short: zstd, and the shuffles behind the table go as soon as it
    is written. Inside ``scratch`` the table goes with the block, but for one to ``keep``."""
    with released(df.sparkSession):
        return _written(df, df.write.option("compression", "zstd"), not keep)


def _written(df, writer, passing: bool = False):
    import uuid
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/{app}/{uuid.uuid4().hex}"
    if passing and getattr(_SCRATCH, "made", None):
        _SCRATCH.made[-1].append(path)
    writer.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: By thread: for each ``scratch`` block it is in, the folders that ``hold`` wrote.
_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what ``hold`` wrote inside, in this thread: nothing planned on it may run later."""
    if not hasattr(_SCRATCH, "made"):
        _SCRATCH.made = []
    _SCRATCH.made.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.made.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def with_conf(spark: SparkSession, conf: dict):
    """Settings of the session inside, and what they were after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def released(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as each is done: no other execution reads them."""
    return with_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def spread(df, min_partitions: int | None = None):
    """Spread rows over the cluster before CPU-heavy per-row work (HTML parsing,
    embedding) when the input has fewer partitions than task slots — e.g. a small
    file written as one row group. Large inputs already have enough partitions and
    are returned unchanged (no extra shuffle). Call it on source scans: the check
    plans ``df``, which is cheap for a scan and costly for a long pipeline."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
