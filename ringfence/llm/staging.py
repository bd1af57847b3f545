"""Written stages: cut lineage through the shared checkpoint folder.

A stage is a parquet table under ``spark.checkpoint.dir``. Reading it back
costs no recomputation after a lost executor, and the shuffle files that
produced it are released as soon as it is written, so an operator's peak
disk use is that of its largest stage and not their sum.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Rows and bytes of text that go to a Python worker at once. Spark's default of
# 10,000 rows says nothing about bytes, and texts are long.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are bounded for texts (smaller settings stay)."""
    conf = df.sparkSession.conf
    for key, most in _BATCH.items():
        now = conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df

# A writer holds a row group in the executor's heap, and pages go through direct
# memory that is kept for the next ones: both are bounded, also for wide cells.
_WRITTEN = {"parquet.block.size": 16 << 20, "parquet.page.size": 512 << 10, "parquet.page.size.row.check.min": 10}


@contextmanager
def released_shuffles(spark: SparkSession):
    """Inside, a finished write or action drops its own shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, f"llm-{name}")
    with released_shuffles(spark):
        df.write.options(compression=compression, **_WRITTEN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete stages that no returned plan reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
