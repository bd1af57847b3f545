"""Sources and sinks.

Tables live as open columnar files (parquet by default). Iceberg / Delta
tables work through the same calls when their catalog jars are on the
classpath (``catalog_table`` / ``fmt``); nothing here depends on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def modernize(df: DataFrame, target: str, fmt: str = "parquet",
              catalog_table: str | None = None, properties: dict[str, str] | None = None,
              partition_by: list[str] | None = None) -> None:
    """Land a table as create-or-replace (full overwrite).

    With ``catalog_table`` on a v2 catalog (e.g. Iceberg) this is
    ``writeTo(..).createOrReplace()`` with table properties; otherwise an
    overwrite of ``target`` in ``fmt``. The data is written by the
    executors; nothing passes through the driver."""
    if catalog_table:
        w = df.writeTo(catalog_table)
        for k, v in (properties or {"write.format.default": fmt}).items():
            w = w.tableProperty(k, v)
        if partition_by:
            w = w.partitionedBy(*[F.col(c) for c in partition_by])
        w.createOrReplace()
        return
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(target)


def read_transactions(spark: SparkSession, path: str,
                      schema: T.StructType = schemas.HISTORICAL_TRANSACTIONS,
                      fmt: str = "parquet") -> DataFrame:
    """Explicit-schema load (no inference; columns pruned at the scan)."""
    return spark.read.schema(schema).format(fmt).load(path)


def register_archive(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """S3: query an archive in place under a SQL name."""
    spark.read.format(fmt).load(path).createOrReplaceTempView(name)
    return spark.table(name)


def parse_legacy_timestamp(df: DataFrame, col: str = "timestamp",
                           fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """F10 on a table: text timestamp -> timestamp_ntz (NULL when malformed)."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col), F.lit(fmt)).cast("timestamp_ntz"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every target column in target order and type; absent columns
    become typed NULLs; extra columns are dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def append_conformed(df: DataFrame, schema: T.StructType, path: str, fmt: str = "parquet") -> None:
    """Append rows that give only some columns."""
    conform(df, schema).write.mode("append").format(fmt).save(path)


def append_kyc_audit(df: DataFrame, path: str) -> None:
    """Append to the KYC audit log."""
    append_conformed(df, schemas.KYC_AUDIT_LOG, path)


def read_kyc_audit(spark: SparkSession, path: str) -> DataFrame:
    """Scan the KYC audit log."""
    return spark.read.schema(schemas.KYC_AUDIT_LOG).parquet(path)


def document_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """Object-table style listing (uri, size, modification time).

    ``binaryFile`` with the content column pruned lists the files without
    reading them."""
    return (spark.read.format("binaryFile").load(pattern)
            .select(F.col("path").alias("document_uri"), F.col("length").alias("size_bytes"),
                    F.col("modificationTime").alias("modified_at")))


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "parquet",
                file_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Append-only stream source; only newly arrived files are read.

    ``file_glob`` restricts a shared folder to one table's files. A Kafka
    source is the production swap (connector jar not bundled)."""
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(directory)


def read_txn_stream(spark: SparkSession, directory: str, **kw) -> DataFrame:
    """The live transaction stream."""
    return read_stream(spark, directory, schemas.LIVE_TRANSACTIONS, **kw)


def read_auth_stream(spark: SparkSession, directory: str, **kw) -> DataFrame:
    """The authentication event stream."""
    return read_stream(spark, directory, schemas.AUTH_EVENTS, **kw)
