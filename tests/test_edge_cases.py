
import datetime as dt

from pyspark.sql import functions as F

from ringfence import schemas
from ringfence.operators import graph as G
from ringfence.operators import scoring as SCR
from ringfence.sources import testdata as td
from ringfence.streaming import streams as ST

from . import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_transfer_cycles_are_walks(spark):
    t0 = dt.datetime(2026, 1, 1)
    acc = spark.createDataFrame([("v", "n", "VICTIM_COMPROMISED"), ("b", "n", "ACTIVE")], schemas.ACCOUNTS)
    tr = spark.createDataFrame([("1", "v", "b", 1.0, t0), ("2", "b", "v", 1.0, t0)], schemas.TRANSFERS) \
        .withColumnRenamed("transfer_id", "order_id")
    empty = spark.createDataFrame([], schemas.USED_DEVICE)
    g = G.FraudGraph(acc, spark.createDataFrame([], schemas.DEVICES), spark.createDataFrame([], schemas.ADDRESSES),
                     empty, spark.createDataFrame([], schemas.SHIPPED_TO), tr)
    got = sorted(tuple(r) for r in G.transfer_paths(g, 1, 4).collect())
    assert got == sorted([("v", "b", 1, 1), ("v", "v", 2, 1), ("v", "b", 3, 1), ("v", "v", 4, 1)])


def test_hop_counts_within_range_and_ring_subset(spark):
    g = td.graph(spark, SF)
    hops = {r.hop_count for r in G.transfer_paths(g, 2, 3).select("hop_count").distinct().collect()}
    assert hops <= {2, 3}
    strict = G.syndicate_ring(g, True)
    walk = G.syndicate_ring(g, False)
    assert strict.subtract(walk).count() == 0
    assert walk.count() >= strict.count()


def test_blocked_iff_some_flag(spark):
    sc = SCR.score_batch(spark, td.transactions(spark, SF), td.devices(spark, SF), SCR.TESTDATA_PARAMS)
    any_flag = (F.col("is_suspicious_device") | F.col("is_high_risk_amount")
                | F.col("is_bin_attack") | F.col("is_impossible_travel"))
    bad = sc.filter((F.col("verdict") == "BLOCKED") != any_flag).count()
    assert bad == 0
    assert sc.filter((F.col("vector") == "CLEAN") & (F.col("verdict") == "BLOCKED")).count() == 0


def test_replayed_ids_are_dropped(spark, tmpdir_fresh):
    live = FX.live(spark)
    live.write.parquet(f"{tmpdir_fresh}/in")
    live.limit(3).write.mode("append").parquet(f"{tmpdir_fresh}/in")  # replayed rows
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).parquet(f"{tmpdir_fresh}/in")
    out = ST.run_to_table(spark, ST.dedupe_replays(stream, "transaction_id", "1 day"),
                          f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    assert out.count() == 9 and out.select("transaction_id").distinct().count() == 9


def test_late_events_do_not_reopen_windows(spark, tmpdir_fresh):
    auth = FX.auth(spark)
    far = spark.createDataFrame([("s1", "acc_x", "dev_other", None, "PASSWORD_RESET",
                                  FX.T0 + dt.timedelta(days=1))], schemas.AUTH_EVENTS)
    late = spark.createDataFrame([("late", "acc_y", "dev_fp_ring_99", None, "PASSWORD_RESET",
                                   FX.T0 + dt.timedelta(seconds=30))], schemas.AUTH_EVENTS)
    auth.unionByName(far).coalesce(1).write.parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schemas.AUTH_EVENTS).option("maxFilesPerTrigger", "1") \
        .parquet(f"{tmpdir_fresh}/in")
    q = ST.write_scored(ST.ato_stream(stream, "4 minutes", "1 minute", 3), f"{tmpdir_fresh}/out",
                        f"{tmpdir_fresh}/ck")
    q.awaitTermination(300)
    late.write.mode("append").parquet(f"{tmpdir_fresh}/in")  # arrives after the watermark passed
    q = ST.write_scored(ST.ato_stream(stream, "4 minutes", "1 minute", 3), f"{tmpdir_fresh}/out",
                        f"{tmpdir_fresh}/ck")
    q.awaitTermination(300)
    out = spark.read.parquet(f"{tmpdir_fresh}/out").collect()
    assert [(r.device_id, r.n_accounts) for r in out] == [("dev_fp_ring_99", 3)]


def test_empty_stream(spark, tmpdir_fresh):
    spark.createDataFrame([], schemas.LIVE_TRANSACTIONS).write.parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).parquet(f"{tmpdir_fresh}/in")
    out = ST.run_to_table(spark, ST.geo_velocity_stream(stream), f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    assert out.count() == 0


def test_null_coordinates_and_null_flags(spark):
    from ringfence.operators import detectors as DT

    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", "x", t, None, None, 1.0), ("b", "x", t + dt.timedelta(hours=1), 1.0, 1.0, 1.0)],
                               "transaction_id string, account_id string, timestamp timestamp, "
                               "latitude double, longitude double, amount double")
    out = {r.transaction_id: r for r in DT.geo_velocity(df).collect()}
    assert set(out) == {"b"} and out["b"].calculated_speed_kmh == 0.0


def test_smurfing_hot_path_equals_pair_join(spark):
    from ringfence.operators import detectors as DT

    tr = td.graph(spark, SF).transferred
    w = 30 * 86_400_000_000
    cold = DT.smurfing(tr, w, 2)
    hot = DT.smurfing(tr, w, 2, max_pairs_per_group=0)  # every group through the dominance path
    assert cold.count() > 0
    assert cold.subtract(hot).count() == 0 and hot.subtract(cold).count() == 0
    g = FX.graph(spark)
    assert [r.n_splits for r in DT.smurfing(g.transferred, w, 3, max_pairs_per_group=0).collect()] == [4]


def test_deep_paths_with_lineage_cut(spark):
    g = td.graph(spark, SF)
    plain = G.transfer_paths(g, 1, 5)
    cut = G.transfer_paths(g, 1, 5, checkpoint_every=2)
    assert plain.count() > 0
    assert plain.subtract(cut).count() == 0 and cut.subtract(plain).count() == 0
