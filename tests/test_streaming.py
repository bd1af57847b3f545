"""Stream / batch parity over several micro-batches, with replayed rows."""

import datetime as dt

from pyspark.sql import functions as F

from ringfence import schemas
from ringfence.operators import detectors as DT
from ringfence.streaming import streams as ST

from . import fixtures as FX


def _land(spark, df, folder, n_files):
    """Write ``df`` in time order as ``n_files`` parquet files (one per batch)."""
    rows = df.orderBy("timestamp", "transaction_id").collect()
    step = max(1, len(rows) // n_files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(folder)


def _events(spark, n=300):
    base = dt.datetime(2026, 1, 1)
    data = []
    for i in range(n):
        acct = f"a{i % 7}" if i % 3 else "hot"
        k = (i * 37) % 25
        data.append((f"t{i:04d}", acct, float((i * 13) % 40) + 0.5, "cat", f"d{i % 5}", None, None,
                     base + dt.timedelta(minutes=7 * i), "POS", (k % 25) * 3.0 - 36.0, (k // 4) * 12.0 - 150.0,
                     f"4111{i % 3}", None, None))
    return spark.createDataFrame(data, schemas.LIVE_TRANSACTIONS)


def test_geo_stream_matches_batch(spark, tmpdir_fresh):
    ev = _events(spark)
    _land(spark, ev, f"{tmpdir_fresh}/in", 6)
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).option("maxFilesPerTrigger", "1") \
        .parquet(f"{tmpdir_fresh}/in")
    out = ST.run_to_table(spark, ST.geo_velocity_stream(stream, watermark="1 hour"),
                          f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    batch = DT.geo_velocity(ev)
    cols = ["transaction_id", "prev_transaction_id", "distance_km", "calculated_speed_kmh", "is_impossible_travel"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_bin_stream_closed_windows_match_batch(spark, tmpdir_fresh):
    ev = _events(spark)
    _land(spark, ev, f"{tmpdir_fresh}/in", 5)
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).option("maxFilesPerTrigger", "1") \
        .parquet(f"{tmpdir_fresh}/in")
    q = ST.bin_attack_stream(stream, "2 hours", "2 hours", "30 minutes", 10.0, 2)
    out = ST.run_to_table(spark, q, f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    wm = ev.agg(F.max("timestamp")).collect()[0][0] - dt.timedelta(minutes=30)
    batch = (DT.bin_velocity(ev, "2 hours", 10.0, 2)
             .withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 2 HOURS"))
             .filter(F.col("window_end") <= F.lit(wm)))
    got = sorted((r.window_start, r.card_bin, r.n_attempts) for r in out.collect())
    want = sorted((r.window_start, r.card_bin, r.n_attempts) for r in batch.collect())
    assert got == want and len(got) > 0


def test_ato_stream_alert(spark, tmpdir_fresh):
    auth = FX.auth(spark)
    far = spark.createDataFrame([("sentinel", "acc_x", "dev_other", None, "PASSWORD_RESET",
                                  FX.T0 + dt.timedelta(days=1))], schemas.AUTH_EVENTS)
    auth.unionByName(far).write.parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schemas.AUTH_EVENTS).parquet(f"{tmpdir_fresh}/in")
    out = ST.run_to_table(spark, ST.ato_stream(stream, "4 minutes", "1 minute", 3),
                          f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck").collect()
    assert [(r.device_id, r.n_accounts) for r in out] == [("dev_fp_ring_99", 3)]


def test_score_stream_batches_are_idempotent(spark, tmpdir_fresh):
    ev = _events(spark, 60)
    _land(spark, ev, f"{tmpdir_fresh}/in", 3)
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).option("maxFilesPerTrigger", "1") \
        .parquet(f"{tmpdir_fresh}/in")
    q = ST.score_stream(stream, f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    q.awaitTermination(300)
    out = spark.read.parquet(f"{tmpdir_fresh}/out")
    assert out.count() == 60 and out.select("transaction_id").distinct().count() == 60
    assert {r.verdict for r in out.select("verdict").distinct().collect()} <= {"BLOCKED", "APPROVED"}


def test_score_stream_with_history_matches_batch(spark, tmpdir_fresh):
    from ringfence.operators import scoring as SCR

    ev = _events(spark, 120)
    _land(spark, ev, f"{tmpdir_fresh}/in", 4)
    params = SCR.ScoringParams(micro_amount=10.0, bin_window_us=6 * 3_600_000_000, bin_min_count=2,
                               spike_factor=3.0, dormant_gap_us=3_600_000_000, dormant_min_amount=20.0)
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).option("maxFilesPerTrigger", "1") \
        .parquet(f"{tmpdir_fresh}/in")
    q = ST.score_stream(stream, f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck", params=params,
                        raw_path=f"{tmpdir_fresh}/raw", lookback="90 days")
    q.awaitTermination(600)
    cols = ["transaction_id", "is_bin_attack", "is_impossible_travel", "is_spend_spike",
            "is_dormant_bust_out", "verdict", "vector"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmpdir_fresh}/out").select(cols).collect()))
    want = sorted(map(tuple, SCR.score_batch(spark, ev, None, params).select(cols).collect()))
    assert len(got) == 120 and got == want
    assert any(r[1] for r in want) and any(r[3] or r[4] for r in want)
