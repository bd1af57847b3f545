"""Keyed state of a ``foreachBatch`` query as a table in bucket folders.

Structured Streaming gives a micro-batch to a function; what that function must
remember between batches lies here. Keys are hashed into buckets and a batch
rewrites only the buckets that its keys fall into, so what is written follows
the batch and not all keys ever seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path


class KeyedState:
    """Rows of state by ``key`` under ``base``.

    ``versions/<batch>`` names, for every bucket, the batch that wrote it last;
    the rows lie in ``rows/version=<batch>/bucket=<n>``. A batch reads the
    versions of the batch before it, so a batch that runs again after a crash
    finds the state that it found at first. Folders that neither this batch nor
    the one before it names are deleted. At most ``buckets`` pairs of integers
    come to the driver."""

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int = 64):
        self.spark, self.base, self.key, self.buckets = spark, base.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def versions(self, batch_id: int) -> dict[int, int]:
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.base}/versions/{batch_id}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``rows``."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.base}/rows/version={version}/bucket={bucket}"

    def read(self, batch_id: int, touched: list[int]) -> DataFrame | None:
        """The rows that batch ``batch_id`` finds in these buckets (None: none yet)."""
        found = self.versions(batch_id - 1)
        folders = [self._folder(b, found[b]) for b in touched if b in found]
        return self.spark.read.parquet(*folders) if folders else None

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def newest(self) -> DataFrame | None:
        """All rows as the newest finished batch left them (None: no rows)."""
        fs, path = self._files(f"{self.base}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n) for n in names if fs.exists(self._files(f"{self.base}/versions/{n}/_SUCCESS")[1])]
        found = self.versions(max(done)) if done else {}
        folders = [self._folder(b, v) for b, v in sorted(found.items())]
        return self.spark.read.parquet(*folders) if folders else None

    def write(self, batch_id: int, rows: DataFrame | None, touched: list[int]) -> None:
        """``rows`` become the whole state of the touched buckets."""
        before = self.versions(batch_id - 1)
        now = dict(before)
        if rows is not None and touched:
            (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite")
             .partitionBy("bucket").parquet(f"{self.base}/rows/version={batch_id}"))
            for b in touched:  # a bucket that is left without rows has no folder
                fs, folder = self._files(self._folder(b, batch_id))
                if fs.exists(folder):
                    now[b] = batch_id
                else:
                    now.pop(b, None)
        (self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.base}/versions/{batch_id}"))
        older = self.versions(batch_id - 2) if batch_id >= 2 and before else {}
        for b, v in older.items():
            if before.get(b) != v:  # replaced by the batch before: no batch reads it again
                drop_path(self.spark, self._folder(b, v))
        if batch_id >= 3:
            drop_path(self.spark, f"{self.base}/versions/{batch_id - 3}")
