"""Structured Streaming operators.

Event time is the ``timestamp`` column (an instant). Every stateful query
declares a watermark, so state for closed windows is evicted; rows later
than the watermark are dropped by the stateful operators (they are still in
the raw table for batch correction).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators.detectors import geo_velocity
from ..operators.scoring import ScoringParams, score_batch
from ..session import drop_path

DEFAULT_WATERMARK = "10 minutes"


def event_time(stream: DataFrame, col: str = "timestamp") -> DataFrame:
    """Streams need an instant for watermarks; timestamp_ntz is re-read as UTC."""
    return stream.withColumn(col, F.col(col).cast("timestamp"))


def score_stateless(stream: DataFrame, devices: DataFrame | None = None,
                    high_risk_amount: float = 500.0) -> DataFrame:
    """Per-event flags that need no history (P7, P16) plus processed_at.

    ``devices`` adds the emulator flag of the device dimension through a
    stream-static left join."""
    out = stream
    emulator = SC.is_emulator("device_id") == 1
    if devices is not None:
        emu = devices.filter(F.col("is_emulator")).select("device_id", F.lit(True).alias("__emu"))
        out = out.join(emu, "device_id", "left")
        emulator = emulator | SC.null_false("__emu")
    return out.select(
        "transaction_id", "account_id", "amount", "merchant_category", "device_id", "timestamp",
        emulator.alias("is_suspicious_device"),
        SC.is_high_risk_amount("amount", high_risk_amount).alias("is_high_risk_amount"),
        F.current_timestamp().alias("processed_at"))


def _span_us(spark: SparkSession, interval: str) -> int:
    """Length of an interval text in micros."""
    span = F.expr(f"unix_micros(timestamp'2000-01-01' + interval {interval}) - unix_micros(timestamp'2000-01-01')")
    return int(spark.range(1).select(span).first()[0])


def bin_attack_stream(stream: DataFrame, window: str = "1 minute", slide: str = "10 seconds",
                      watermark: str = DEFAULT_WATERMARK, max_amount: float = 2.0,
                      min_count: int = 80) -> DataFrame:
    """R2: micro-amount attempts per BIN in sliding event-time windows.

    Attempts are first counted in panes of one slide; the windows then add up
    their panes. So a row is counted once and only a BIN's panes are copied into
    the window / slide windows that overlap them. A window that is no whole
    number of slides has no such panes and is counted from the rows."""
    micro = stream.filter(F.col("amount") <= F.lit(max_amount)).withWatermark("timestamp", watermark)
    spark = stream.sparkSession
    if _span_us(spark, window) % _span_us(spark, slide) == 0:
        panes = micro.groupBy(F.window("timestamp", slide).alias("pane"), "card_bin").agg(F.count(F.lit(1)).alias("n"))
        windows = (panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("window"), "card_bin")
                   .agg(F.sum("n").alias("n_attempts")))
    else:
        windows = (micro.groupBy(F.window("timestamp", window, slide).alias("window"), "card_bin")
                   .agg(F.count(F.lit(1)).alias("n_attempts")))
    return (windows.filter(F.col("n_attempts") >= min_count)
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "card_bin", "n_attempts"))


def ato_stream(auth: DataFrame, window: str = "4 minutes", watermark: str = DEFAULT_WATERMARK,
               min_accounts: int = 3) -> DataFrame:
    """Distinct accounts per device in tumbling windows.

    Exact and bounded: a first aggregation keeps one row per (window,
    device, account); a second, chained on the first window's event time,
    counts them. No per-device set of accounts is held in one state row.
    """
    per_acct = (auth.withWatermark("timestamp", watermark)
                .groupBy(F.window("timestamp", window).alias("w"), "device_id", "account_id")
                .agg(F.count(F.lit(1)).alias("n_events")))
    per_dev = (per_acct.groupBy(F.window(F.window_time("w"), window).alias("window"), "device_id")
               .agg(F.count(F.lit(1)).alias("n_accounts"), F.sum("n_events").alias("n_events")))
    return (per_dev.filter(F.col("n_accounts") >= min_accounts)
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "device_id", "n_accounts", "n_events"))


GEO_COLUMNS = ("transaction_id", "account_id", "latitude", "longitude", "timestamp")


def _geo_step(spark: SparkSession, rows: DataFrame, base: str, batch_id: int, delay_us: int | None,
              max_kmh: float, min_jump_km: float, buckets: int) -> None:
    """One micro-batch of R4. ``state/b`` holds what batch b leaves to the next:
    ``pending`` (located swipes the watermark has not passed) and ``clock`` (the
    newest time seen); the newest emitted swipe of each account lies in
    ``last``, of which a batch rewrites its own accounts' buckets. Folders that
    no later batch reads are deleted. ``delay_us`` None: flush, which gives what
    waits and leaves the state as it is."""
    from .keyed_state import KeyedState

    last_swipes = KeyedState(spark, f"{base}/last", "account_id", buckets)
    here, there = f"{base}/state/{batch_id}", f"{base}/state/{batch_id - 1}"
    pending = spark.read.schema(rows.schema).parquet(f"{there}/pending") if batch_id > 0 else None
    seen = spark.read.schema("clock long").parquet(f"{there}/clock").first()[0] if batch_id > 0 else None
    newest = rows.agg(F.unix_micros(F.max("timestamp").cast("timestamp"))).first()[0]
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    if seen is not None and delay_us is not None:  # later than the watermark: kept apart, never moves the state back
        rows.filter(t <= seen - delay_us).write.mode("overwrite").parquet(f"{base}/late/{batch_id}")
        rows = rows.filter(t > seen - delay_us)
    both = rows if pending is None else pending.unionByName(rows)
    top = max([x for x in (seen, newest) if x is not None], default=None)
    flush = delay_us is None or top is None
    ready = both if flush else both.filter(t <= top - delay_us)
    touched = last_swipes.touched(ready)
    last = last_swipes.read(batch_id, touched)
    if delay_us is not None:
        (both.limit(0) if flush else both.filter(t > top - delay_us)).write.mode("overwrite").parquet(f"{here}/pending")
        spark.createDataFrame([(top,)], "clock long").coalesce(1).write.mode("overwrite").parquet(f"{here}/clock")
        with_last = ready if last is None else last.unionByName(ready)
        newest_of = with_last.groupBy("account_id").agg(F.max(F.struct("timestamp", *GEO_COLUMNS[:1], *GEO_COLUMNS[2:4])).alias("s"))
        last_swipes.write(batch_id, newest_of.select("s.transaction_id", "account_id", "s.latitude", "s.longitude", "s.timestamp"), touched)
    # a swipe of ``last`` only serves as predecessor: it is marked and not given again
    marked = ready.withColumn("__new", F.lit(True))
    if last is not None:
        marked = last.withColumn("__new", F.lit(False)).unionByName(marked)
    out = geo_velocity(marked, max_kmh, min_jump_km, keep=("__new",)).filter("__new").drop("__new")
    out.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
    if batch_id >= 2 and delay_us is not None:
        drop_path(spark, f"{base}/state/{batch_id - 2}")


@dataclass(frozen=True)
class OrderedGeoVelocity:
    """R4 as a running query: ``run_to_table`` runs it to the stream's end."""

    stream: DataFrame
    max_kmh: float
    min_jump_km: float
    delay_us: int
    flush: bool
    state_buckets: int = 64

    def run_to(self, path: str, checkpoint: str, trigger: dict | None = None) -> DataFrame:
        """State, late rows and output lie under ``path``; gives the output."""
        spark, base, done = self.stream.sparkSession, path.rstrip("/"), [-1]
        located = self.stream.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(*GEO_COLUMNS)

        def step(batch: DataFrame, batch_id: int) -> None:
            _geo_step(batch.sparkSession, batch, base, batch_id, self.delay_us, self.max_kmh, self.min_jump_km, self.state_buckets)
            done[0] = batch_id

        q = (located.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(**(trigger or {"availableNow": True})).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        if self.flush and done[0] >= 0:
            _geo_step(spark, spark.createDataFrame([], located.schema), base, done[0] + 1, None, self.max_kmh, self.min_jump_km, self.state_buckets)
        return spark.read.parquet(f"{base}/out").drop("batch_id")


def geo_velocity_stream(stream: DataFrame, max_kmh: float = 900.0, min_jump_km: float = 100.0,
                        watermark: str = DEFAULT_WATERMARK, flush: bool = True,
                        state_buckets: int = 64) -> OrderedGeoVelocity:
    """R4 in event-time order: the result equals the batch detector's.

    Swipes wait until the watermark (newest time seen minus the delay) passes
    them and are then compared with their predecessor in time, wherever it
    arrived. A swipe later than the watermark goes to ``late/`` and changes
    nothing. The newest swipe of each account is kept without expiry, so an
    account that returns after weeks still has its predecessor. All work is
    the sliced JVM window of the batch detector: a hot account is split over
    time slices. Steps are idempotent per batch id. ``flush`` emits what
    still waits when a finite stream has ended. A batch rewrites the newest
    swipes of its own accounts' ``state_buckets`` only: choose them so that a
    bucket holds about as much as a shuffle partition."""
    return OrderedGeoVelocity(stream, max_kmh, min_jump_km, _span_us(stream.sparkSession, watermark), flush, state_buckets)


def spike_stream(stream: DataFrame, profile: DataFrame, factor: float = 30.0) -> DataFrame:
    """Compare each event with a batch-computed account profile
    ``(account_id, baseline_n, baseline_total)`` through a stream-static
    join; flagged when amount * n >= factor * total."""
    from decimal import Decimal

    from ..operators.triage import MONEY

    j = stream.join(profile, "account_id", "inner")
    amt = F.col("amount").cast(MONEY)
    flag = (F.col("baseline_n") > 0) & (amt * F.col("baseline_n") >= F.lit(Decimal(str(factor))) * F.col("baseline_total"))
    return j.filter(flag).select("transaction_id", "account_id", "amount", "baseline_n", "baseline_total")


def write_scored(scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                 partition_by: list[str] | None = None):
    """Append the scored stream to a parquet table with a checkpoint
    (exactly-once file sink)."""
    w = (scored.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.trigger(**(trigger or {"availableNow": True})).start()


AUTH_COLUMNS = ("event_id", "account_id", "device_id", "timestamp")


def _land(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Rows of a micro-batch join the landed table, by event date and batch (a
    replayed batch replaces its own folders only); gives all rows landed so far."""
    dated = rows.withColumn("event_date", F.to_date("timestamp")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "batch_id").parquet(path))
    return rows.sparkSession.read.schema(dated.schema).parquet(path).filter(F.col("batch_id") <= batch_id)


def _between(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows of a landed table with a timestamp in [low, high]; other dates are not read."""
    return rows.filter(F.col("event_date").between(F.to_date(low), F.to_date(high)) & F.col("timestamp").between(low, high))


def _micros(us: int) -> Column:
    return F.make_dt_interval(secs=F.lit(us) / F.lit(1e6))


def _newest(rows: DataFrame) -> DataFrame:
    """Of each account the newest row and the newest one with coordinates."""
    rest = [c for c in rows.columns if c not in ("account_id", "timestamp")]
    row = F.struct("timestamp", *rest)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    top = (rows.filter(F.col("timestamp").isNotNull()).groupBy("account_id")
           .agg(F.max(row).alias("any"), F.max(F.when(located, row)).alias("located")))
    each = F.explode(F.array_distinct(F.array_compact(F.array("any", "located"))))
    return top.select("account_id", each.alias("r")).select("account_id", "r.*").select(*rows.columns)


def _history(recent: DataFrame, todo: DataFrame, landed: DataFrame, state: DataFrame, since: Column) -> DataFrame:
    """Rows before ``since`` that the rows to be scored look back to: of their
    accounts the newest row and the newest located one, from the state.

    The state knows the newest rows only. An account may have rows in ``recent``
    that came before the one scored now but lie after it in time; if nothing
    else of it lies between, its older rows are looked up in the landed table."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()

    def firsts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("account_id").agg(F.min("timestamp").alias(name), F.min(F.when(located, F.col("timestamp"))).alias(f"{name}_located"))

    state = state.join(todo.select("account_id").distinct(), "account_id", "left_semi")
    newer = (state.filter(F.col("timestamp") >= since).groupBy("account_id")
             .agg(F.max(F.when(located, F.lit(True))).alias("located")))
    late = (newer.join(firsts(recent, "r"), "account_id").join(firsts(todo, "t"), "account_id")
            .filter((F.col("r") == F.col("t")) | (F.col("located") & (F.col("r_located") == F.col("t_located")))).select("account_id"))
    older = state.filter(F.col("timestamp") < since)
    if late.isEmpty():
        return older
    before = landed.filter((F.col("event_date") <= F.to_date(since)) & (F.col("timestamp") < since))
    return older.join(late, "account_id", "left_anti").unionByName(_newest(before.join(late, "account_id", "left_semi")))


def score_stream(stream: DataFrame, path: str, checkpoint: str, devices: DataFrame | None = None,
                 params: ScoringParams = ScoringParams(), trigger: dict | None = None,
                 raw_path: str | None = None, lookback: str = "90 days", auth: DataFrame | None = None,
                 state_buckets: int = 64):
    """R6 on a stream: every micro-batch is scored with the batch detectors
    and written to its own ``batch_id=`` folder with overwrite, so a replayed
    batch replaces its output instead of duplicating it.

    The batch is landed in the raw table (``raw_path``, by default next to
    ``path``; partitioned by event date and batch id, this batch's partitions overwritten on replay); scoring then reads
    the landed rows of the batch's own accounts and BINs. Dates older than
    ``lookback`` before the earliest row to be scored are not read: the newest
    row and the newest located row of each account are kept by ``KeyedState``
    (in ``state_buckets``, each about as large as a shuffle partition), so dormancy and travel have no such bound.

    With ``auth``, a stream of authentication events, takeovers mark and block
    transactions as in batch scoring. A transaction is scored at once, with the
    events known by then. A fan-in that is completed later marks earlier
    transactions too: those are scored again and written with the batch that
    brought the fan-in. ``landed_batch`` and ``landed_row`` name the row, and
    ``current_scores`` gives the newest score of each.
    """
    from .keyed_state import KeyedState

    raw_path = raw_path or f"{path.rstrip('/')}-raw"
    columns = stream.columns
    feed = stream.withColumn("__auth", F.lit(False))
    if auth is not None:
        feed = feed.unionByName(auth.select(*AUTH_COLUMNS).withColumn("__auth", F.lit(True)), allowMissingColumns=True)
    fan_in, hold = _micros(params.ato_window_us), _micros(params.ato_hold_us)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = KeyedState(spark, f"{raw_path}-last", "account_id", state_buckets)
        landed = _land(batch.filter("not __auth").select(*columns, F.monotonically_increasing_id().alias("landed_row")), raw_path, batch_id)
        own = landed.filter(F.col("batch_id") == batch_id)
        todo, revise = own.withColumn("__again", F.lit(False)), F.lit(False)
        if auth is not None:
            events = _land(batch.filter("__auth").select(*AUTH_COLUMNS), f"{raw_path}-auth", batch_id)
            news = events.filter(F.col("batch_id") == batch_id)
            low, high = news.agg(F.min("timestamp"), F.max("timestamp")).first()
            if low is not None:
                low, high = F.lit(low) - fan_in, F.lit(high) + fan_in
                hit = (_between(events, low, high).join(news.select("device_id").distinct(), "device_id", "left_semi")
                       .select("account_id").distinct())
                again = _between(landed.filter(F.col("batch_id") < batch_id), low, high + hold).join(hit, "account_id", "left_semi")
                todo = todo.unionByName(again.withColumn("__again", F.lit(True)))
                revise = (F.col("batch_id") < batch_id) & F.col("timestamp").between(low, high + hold)
            todo.write.mode("overwrite").parquet(f"{raw_path}-todo/{batch_id}")
            todo = spark.read.schema(todo.schema).parquet(f"{raw_path}-todo/{batch_id}")
        n, first, last = todo.agg(F.count(F.lit(1)), F.min("timestamp"), F.max("timestamp")).first()
        mine = state.touched(own)
        if n:
            accounts = todo.groupBy("account_id").agg(F.lit(True).alias("__a"), F.max("__again").alias("__r"))
            bins = todo.select("card_bin").distinct().withColumn("__b", F.lit(True))
            since = F.lit(first) - F.expr(f"INTERVAL {lookback}")
            recent = F.lit(False) if first is None else (F.col("event_date") >= F.to_date(since)) & (F.col("timestamp") >= since)
            this = F.col("batch_id") == batch_id
            rows = (landed.filter(this | recent).join(accounts, "account_id", "left").join(bins, "card_bin", "left")
                    .filter(F.col("__a") | F.col("__b") | this)
                    .withColumn("__again", SC.null_false("__r") & SC.null_false(revise)).drop("__a", "__b", "__r"))
            known = state.read(batch_id, state.touched(todo))
            if known is not None and first is not None:
                history = _history(rows, todo, landed, known, since)
                rows = rows.unionByName(history.withColumn("__again", F.lit(False)))
            near = None
            if auth is not None and first is not None:
                near = _between(events, F.lit(first) - hold - fan_in, F.lit(last) + fan_in)
                near = near.join(near.join(accounts, "account_id", "left_semi").select("device_id").distinct(), "device_id", "left_semi")
            rows = rows.withColumn("__now", this).withColumnRenamed("batch_id", "landed_batch")
            scored = score_batch(spark, rows, devices, params, auth=near, keep=("landed_batch", "landed_row", "__now", "__again"))
            (scored.filter(F.col("__now") | (F.col("__again") & F.col("is_ato"))).drop("__now", "__again")
             .write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}"))
        known = state.read(batch_id, mine)
        state.write(batch_id, _newest(own if known is None else known.unionByName(own)), mine)
        drop_path(spark, f"{raw_path}-todo/{batch_id}")

    return (feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """The newest score of every row that ``score_stream`` has written."""
    rows = spark.read.parquet(path)
    keys = ("landed_batch", "landed_row")
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select(*keys, "s.*").drop("batch_id"))


def run_to_table(spark: SparkSession, df: DataFrame | OrderedGeoVelocity, path: str, checkpoint: str) -> DataFrame:
    """Run a streaming query with ``availableNow`` into parquet and read it."""
    if isinstance(df, OrderedGeoVelocity):
        return df.run_to(path, checkpoint)
    q = write_scored(df, path, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(path)


SENTINEL_TIME = "2100-01-01 00:00:00"


def with_sentinel(stream: DataFrame, folder: str, time: str = "timestamp", **values) -> DataFrame:
    """A finite stream followed by one far-future row (``values`` fill the
    columns that later filters look at), so that the watermark passes every
    real window and all of them are emitted. The sentinel's own window never
    closes."""
    spark = stream.sparkSession
    row = [F.lit(values.get(f.name, None)).cast(f.dataType).alias(f.name) if f.name != time else
           F.lit(SENTINEL_TIME).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).coalesce(1).write.mode("overwrite").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def blocklist_stream(blocks: DataFrame, key: str, path: str, checkpoint: str, ttl: str = "24 hours",
                     trigger: dict | None = None, watermark: str = DEFAULT_WATERMARK, state_buckets: int = 64):
    """R8 on a stream: the live blocklist, with event-time timers.

    State is the latest block of each key that is blocked now. A block is in the
    table from its arrival on; a timer at its expiry takes it out of the state
    and out of the table when the watermark has passed it. The watermark lies on
    the expiry with the ttl added to its delay: it trails the newest block by
    ``watermark``, and a block that arrives late counts as long as it has not
    expired. The table is ``KeyedState`` under ``path``: a micro-batch rewrites
    the buckets of the keys that it blocks or frees only. Rows without a key or
    time block nothing. ``live_blocklist`` reads the table."""
    from pyspark.sql import types as T

    from .expiry import BlockExpiry
    from .keyed_state import KeyedState

    spark, kind = blocks.sparkSession, blocks.schema[key].dataType
    delay_us = _span_us(spark, watermark) + _span_us(spark, ttl)
    changes = T.StructType([T.StructField(key, kind), T.StructField("blocked_us", T.LongType()),
                            T.StructField("expires_us", T.LongType()), T.StructField("active", T.BooleanType())])
    timed = (blocks.filter(F.col(key).isNotNull() & F.col("blocked_at").isNotNull())
             .select(key, F.col("blocked_at").cast("timestamp").alias("blocked_at"))
             .withColumn("expires_at", F.col("blocked_at") + F.expr(f"INTERVAL {ttl}"))
             .withWatermark("expires_at", f"{delay_us} microseconds")
             .withColumns({"blocked_us": F.unix_micros("blocked_at"), "expires_us": F.unix_micros("expires_at")}))
    found = timed.groupBy(key).transformWithStateInPandas(BlockExpiry(key, kind), changes, "Update", "EventTime")
    times = [F.timestamp_micros("blocked_us").alias("last_blocked_at"), F.timestamp_micros("expires_us").alias("expires_at")]
    spark.createDataFrame([], changes).select(key, *times).coalesce(1).write.mode("overwrite").parquet(f"{path}/empty")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = f"{path}/changes/{batch_id}"
        batch.write.mode("overwrite").parquet(log)  # read three times below
        batch = spark.read.schema(changes).parquet(log)
        table = KeyedState(spark, path, key, state_buckets)
        buckets = table.touched(batch)
        # a key may be freed and blocked again in one batch: its latest block counts
        last = batch.groupBy(key).agg(F.max(F.struct("blocked_us", "expires_us", (~F.col("active")).alias("freed"))).alias("c"))
        rows = last.filter("not c.freed").select(key, "c.*").select(key, *times)
        known = table.read(batch_id, buckets)
        if known is not None:
            rows = known.select(rows.columns).join(last.select(key), key, "left_anti").unionByName(rows)
        table.write(batch_id, rows, buckets)
        drop_path(spark, log)

    # timers need the RocksDB store; the query takes its settings when it starts
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def live_blocklist(spark: SparkSession, path: str, key: str, as_of=None) -> DataFrame:
    """(key, last_blocked_at, expires_at) of the blocks in the newest table,
    of which those active at ``as_of``, where given."""
    from .keyed_state import KeyedState

    table, rows = spark.read.parquet(f"{path}/empty"), KeyedState(spark, path, key).newest()
    if rows is not None:
        table = table.unionByName(rows.select(table.columns))
    return table if as_of is None else table.filter(F.col("expires_at") > as_of)


def dedupe_replays(stream: DataFrame, key: str = "transaction_id",
                   watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Drop replayed events: the first row per ``key`` is kept while its
    event time is within the watermark (state is bounded by the delay). A row
    without a key is an event of its own and always kept."""
    own = F.coalesce(F.concat(F.lit("id:"), F.col(key).cast("string")), F.concat(F.lit("row:"), F.expr("uuid()")))
    return (stream.withColumn("__event", own).withWatermark("timestamp", watermark)
            .dropDuplicatesWithinWatermark(["__event"]).drop("__event"))


def resolve_holds_stream(holds: DataFrame, replies: DataFrame, answer_within: str = "24 hours",
                         watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """J8 on streams: every hold with its outcome, once its answer time is over.

    ``holds(hold_id, ..., held_at)`` meet ``replies(hold_id, reply,
    replied_at)`` in a left outer interval join: a reply counts from ``held_at``
    until ``answer_within`` later. A second aggregation, chained on the hold's
    event time, keeps the latest reply (of replies at one time the larger code,
    as in ``resolve_holds``). When the watermark has passed a hold's answer time
    it comes out, PENDING without a reply, and its state goes. A hold that is
    delivered twice with equal columns is one hold."""
    from ..operators.triage import REPLY_OUTCOME

    columns = holds.columns
    h = holds.withWatermark("held_at", watermark)
    r = replies.select(F.col("hold_id").alias("__hold"), "reply", "replied_at").withWatermark("replied_at", watermark)
    answered = (F.col("hold_id") == F.col("__hold")) & F.col("replied_at").between(
        F.col("held_at"), F.col("held_at") + F.expr(f"INTERVAL {answer_within}"))
    last = h.join(r, answered, "leftOuter").groupBy(*columns).agg(F.max(F.when(F.col("replied_at").isNotNull(), F.struct("replied_at", "reply"))).alias("last"))
    outcome = F.create_map(*[F.lit(x) for kv in REPLY_OUTCOME.items() for x in kv])
    return (last.select(*columns, "last.reply", "last.replied_at")
            .withColumn("status", F.coalesce(outcome[F.col("reply")], F.lit("PENDING"))))
