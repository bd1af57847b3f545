"""R5 with a profile that a stream keeps itself, from daily partial sums."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triage import MONEY, MONEY_SUM
from ..session import drop_path
from .keyed_state import KeyedState

PROFILE_COLUMNS = ("transaction_id", "account_id", "amount", "timestamp")


def daily_sums(rows: DataFrame) -> DataFrame:
    """(account_id, day, n, total) of rows with ``day``; hot accounts fold map-side."""
    return rows.groupBy("account_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast(MONEY)).cast(MONEY_SUM).alias("total"))


def profiles_of(asked: DataFrame, daily: DataFrame, days: int) -> DataFrame:
    """For each (account_id, day) of ``asked`` the ``days`` whole days before
    it: baseline_n, baseline_total. Pairs without an earlier row are absent."""
    d = daily.select("account_id", F.col("day").alias("__day"), "n", "total")
    earlier = F.col("__day").between(F.date_sub("day", days), F.date_sub("day", 1))
    return (asked.join(d, "account_id").filter(earlier).groupBy("account_id", "day")
            .agg(F.sum("n").alias("baseline_n"), F.sum("total").cast(MONEY_SUM).alias("baseline_total")))


def spike_profile_stream(stream: DataFrame, path: str, checkpoint: str, days: int = 90, factor: float = 30.0,
                         late_days: int = 7, trigger: dict | None = None, state_buckets: int = 64):
    """R5 without a profile computed elsewhere: events whose amount reaches
    ``factor`` times the mean of their account over the ``days`` whole days
    before their own day.

    State is one row per account and day (``KeyedState``): a micro-batch adds
    its sums to the buckets of its own accounts and retires days there that no
    event can look back to any more. An event sees every row of an earlier day
    that arrived in its own micro-batch or before. Late rows count while their
    day is at most ``late_days`` before the newest day of the batches before;
    rows later than that go to ``late/`` and change nothing. Rows without
    account or time are left out; a missing amount counts as a row of no amount.
    Each batch writes its own ``out/batch_id=`` folder, so a batch that runs
    again replaces it. An account's events join with one row a day and account
    asked for, not with its daily rows."""
    base = path.rstrip("/")
    rows_in = (stream.filter(F.col("account_id").isNotNull() & F.col("timestamp").isNotNull())
               .select(*PROFILE_COLUMNS).withColumn("day", F.to_date("timestamp")))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedState(spark, f"{base}/daily", "account_id", state_buckets)
        batch.write.mode("overwrite").parquet(f"{base}/rows/{batch_id}")  # read several times below
        rows = spark.read.schema(batch.schema).parquet(f"{base}/rows/{batch_id}")
        newest = spark.read.schema("newest date").parquet(f"{base}/clock/{batch_id - 1}").first()[0] if batch_id else None
        if newest is not None:
            floor = F.date_sub(F.lit(newest), late_days)
            rows.filter(F.col("day") < floor).drop("day").write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
            rows = rows.filter(F.col("day") >= floor)
        first, last = rows.agg(F.min("day"), F.max("day")).first()
        top = max([d for d in (newest, last) if d is not None], default=None)
        (spark.range(1).select(F.lit(top).cast("date").alias("newest")).coalesce(1)
         .write.mode("overwrite").parquet(f"{base}/clock/{batch_id}"))
        asked = daily_sums(rows)
        buckets = state.touched(asked)
        daily, known = asked, state.read(batch_id, buckets)
        if known is not None:
            daily = (known.unionByName(asked).groupBy("account_id", "day")
                     .agg(F.sum("n").alias("n"), F.sum("total").cast(MONEY_SUM).alias("total")))
        if first is not None:  # the earliest day that this batch or a later one looks back to
            oldest = F.lit(first) if newest is None else F.date_sub(F.lit(newest), late_days)
            daily = daily.filter(F.col("day") >= F.date_sub(oldest, days))
        state.write(batch_id, daily, buckets)
        daily = state.read(batch_id + 1, buckets)
        out = rows.withColumns({"baseline_n": F.lit(None).cast("long"), "baseline_total": F.lit(None).cast(MONEY_SUM)}).limit(0)
        if daily is not None:
            out = rows.join(profiles_of(asked.select("account_id", "day"), daily, days), ["account_id", "day"])
        flag = F.col("amount").cast(MONEY) * F.col("baseline_n") >= F.lit(Decimal(str(factor))) * F.col("baseline_total")
        (out.filter(flag).select(*PROFILE_COLUMNS, "baseline_n", "baseline_total")
         .write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}"))
        drop_path(spark, f"{base}/rows/{batch_id}")
        if batch_id >= 2:
            drop_path(spark, f"{base}/clock/{batch_id - 2}")

    return (rows_in.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_profiles(spark: SparkSession, path: str, as_of, days: int = 90) -> DataFrame:
    """(account_id, baseline_n, baseline_total) of the ``days`` whole days before
    the date ``as_of``, for every account with rows there."""
    daily = KeyedState(spark, f"{path.rstrip('/')}/daily", "account_id").newest()
    if daily is None:
        return spark.createDataFrame([], f"account_id string, baseline_n long, baseline_total {MONEY_SUM}")
    inside = F.col("day").between(F.date_sub(as_of, days), F.date_sub(as_of, 1))
    return (daily.filter(inside).groupBy("account_id")
            .agg(F.sum("n").alias("baseline_n"), F.sum("total").cast(MONEY_SUM).alias("baseline_total")))
