"""Session helpers.

Library code never creates its own cluster settings: it reads what the
session already has. ``local_session`` is for tests, the bench and the
command line only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query relies on. Timestamps in the inputs are
# ``timestamp_ntz``; converting them to epoch micros goes through the
# session zone, so it must be UTC for exact interval arithmetic.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Defaults for a session we create ourselves. On a cluster these come
# from the job submission instead.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.driver.memory": "16g",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def ensure_query_conf(spark: SparkSession) -> SparkSession:
    """Pin the few settings the query semantics depend on."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ringfence") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**LOCAL_CONF, **REQUIRED_CONF}.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; a local session gets
    a fresh scratch folder only when nothing is configured.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("spark.checkpoint.dir is not set on this session")
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set a checkpoint folder only where the session has none, and only in
    local mode (tests, local runs); a cluster session must name a shared one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            # Executors on other machines cannot read a driver-local folder.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
        path = tempfile.mkdtemp(prefix="ringfence-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` once to a fresh folder under the shared checkpoint folder
    and read it back.

    Used where one derived table feeds several branches of a plan: the
    branches then scan the written files instead of each re-running the
    joins that produced it, and the lineage is cut, so a lost executor only
    recomputes from the files."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


ROWS_A_TASK = 1_000_000


def spread(df, rows: int, *keys: str):
    """``df`` of ``rows`` rows by ``keys`` in parts of about ``ROWS_A_TASK``
    rows, so that what a task holds does not grow with the table; as it is while
    that gives no more parts than the session's tasks at a time."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder of the shared file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
