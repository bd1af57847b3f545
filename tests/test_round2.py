"""Replays, NULL keys, one amount rule, streams out of order, live blocks, KYC truth."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ringfence import schemas
from ringfence.functions import scalars as SC
from ringfence.operators import detectors as DT
from ringfence.operators import graph as G
from ringfence.operators import kyc as KY
from ringfence.operators import scoring as SCR
from ringfence.operators.sliced import range_sums, sliced_prev
from ringfence.streaming import streams as ST

from . import fixtures as FX
from .test_streaming import _events

PARAMS = SCR.ScoringParams(micro_amount=10.0, bin_window_us=6 * 3_600_000_000, bin_min_count=3, spike_factor=3.0,
                           dormant_gap_us=3_600_000_000, dormant_min_amount=20.0)


def test_replays_and_null_ids_keep_one_row_each(spark):
    ev = _events(spark, 60).cache()
    plain = {r.transaction_id: r for r in SCR.score_batch(spark, ev, None, PARAMS).collect()}
    replay = ev.filter("transaction_id in ('t0003', 't0010')")
    doubled = SCR.score_batch(spark, ev.unionByName(replay), None, PARAMS).collect()
    assert len(doubled) == 62
    for r in doubled:  # a replay adds no attempt, no amount and no swipe
        p = plain[r.transaction_id]
        assert (r.is_bin_attack, r.is_spend_spike, r.is_impossible_travel, r.verdict) == (
            p.is_bin_attack, p.is_spend_spike, p.is_impossible_travel, p.verdict)
    burst = ev.limit(1).select("*").withColumn("transaction_id", F.lit(None).cast("string"))
    burst = burst.withColumn("amount", F.lit(1.0)).withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).drop("i")
    got = SCR.score_batch(spark, burst, None, PARAMS).collect()
    assert len(got) == 3 and all(r.is_bin_attack and r.verdict == "BLOCKED" for r in got)


def test_no_approved_row_carries_a_decline(spark):
    ev = _events(spark, 150).withColumn("latitude", F.lit(None).cast("double"))  # no travel, so few rows are blocked
    rows = SCR.score_batch(spark, ev, None, PARAMS).collect()
    approved = [r for r in rows if r.verdict == "APPROVED"]
    assert approved and not any("DECLINE" in r.status_code or r.risk_level == "Critical" for r in approved)
    assert any(r.vector == "REVIEW" for r in approved)
    assert all(r.vector not in ("CLEAN", "REVIEW") for r in rows if r.verdict == "BLOCKED")


def test_takeover_marks_the_accounts_events(spark):
    ev = _events(spark, 20)
    t0 = dt.datetime(2026, 1, 1)
    auth = spark.createDataFrame([(f"e{i}", a, "dev", None, "PASSWORD_RESET", t0 + dt.timedelta(seconds=20 * i))
                                  for i, a in enumerate(["a1", "a2", "hot"])], schemas.AUTH_EVENTS)
    got = {r.transaction_id: r for r in SCR.score_batch(spark, ev, None, PARAMS, auth=auth).collect()}
    hit = {k for k, r in got.items() if r.is_ato}
    assert hit == {r.transaction_id for r in ev.collect() if r.account_id in ("a1", "a2", "hot") and r.timestamp >= t0 + dt.timedelta(seconds=0)} - {
        r.transaction_id for r in ev.collect() if r.account_id == "hot" and r.timestamp < t0 + dt.timedelta(seconds=40)}
    assert all(got[k].vector == "ATO" and got[k].verdict == "BLOCKED" for k in hit)
    actions = SCR.policy_table(spark).filter("vector = 'ATO'").collect()[0].actions
    assert "INVALIDATE_SESSION" in actions


@pytest.mark.parametrize("width", [1_000_000, 50_000_000, 10_000_000_000])
def test_null_keys_and_bursts_do_not_depend_on_width(spark, width):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice([5, r.randrange(400_000_000)])) for i in range(300)]
    df = spark.createDataFrame([(i, k, t if i % 4 else 777_000) for i, k, t in rows], "id long, k string, t long")
    prev = {x.id: x.prev_id for x in sliced_prev(df, ["k"], "t", "id", width=width).collect()}
    sums = {x.id: x.n for x in range_sums(df, ["k"], "t", "id", {"n": F.lit(1).cast("long")}, -60_000_000, 0, width=width).collect()}
    data = [tuple(x) for x in df.collect()]
    for i, k, t in data:
        same = sorted((u, j) for j, q, u in data if q == k)
        before = [j for u, j in same if (u, j) < (t, i)]
        if k is None:
            assert prev[i] is None and sums[i] is None
        else:
            assert prev[i] == (before[-1] if before else None)
            assert sums[i] == sum(t - 60_000_000 <= u <= t for u, _ in same)


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_smurfing_compares_cents_at_any_size(spark, limit):
    t0 = dt.datetime(2026, 1, 1)
    data = [("i1", "x", "m", 100.004, t0)] + [(f"o{k}", "m", f"y{k}", 100.001, t0 + dt.timedelta(hours=k + 1)) for k in range(3)]
    data += [("I2", "x", "big", 3e12, t0)] + [(f"O{k}", "big", f"z{k}", 1e12, t0 + dt.timedelta(hours=k + 1)) for k in range(3)]
    df = spark.createDataFrame(data, "order_id string, src_account string, dst_account string, amount double, timestamp timestamp_ntz")
    got = [(r.order_id, r.n_splits, float(r.split_total)) for r in DT.smurfing(df, 30 * 86_400_000_000, 3, max_pairs_per_group=limit).collect()]
    assert got == [("I2", 3, 3e12)]


def test_geo_stream_in_event_time_order(spark, tmpdir_fresh):
    """Files out of order, and an account that returns after ten days."""
    ev = _events(spark, 200)
    back = ev.filter("account_id = 'a1'").limit(1).withColumn("transaction_id", F.lit("back")).withColumn(
        "timestamp", F.lit(dt.datetime(2026, 1, 12)).cast("timestamp"))
    ev = ev.unionByName(back.select(*ev.columns))
    rows = ev.orderBy("timestamp").collect()
    chunks = [rows[i:i + 40] for i in range(0, len(rows), 40)]
    for k in range(0, len(chunks) - 2, 2):  # neighbours mixed: every second swipe comes one file later
        mixed = chunks[k] + chunks[k + 1]
        chunks[k], chunks[k + 1] = mixed[::2], mixed[1::2]
    for chunk in chunks:
        spark.createDataFrame(chunk, ev.schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).option("maxFilesPerTrigger", "1").parquet(f"{tmpdir_fresh}/in")
    out = ST.run_to_table(spark, ST.geo_velocity_stream(stream, watermark="2 days"), f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    cols = ["transaction_id", "prev_transaction_id", "distance_km", "calculated_speed_kmh", "is_impossible_travel"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, DT.geo_velocity(ev).select(cols).collect()))
    assert out.filter("transaction_id = 'back'").collect()[0].prev_transaction_id is not None


def test_late_swipe_changes_nothing(spark, tmpdir_fresh):
    ev = _events(spark, 30).filter("account_id = 'hot'")
    rows = ev.orderBy("timestamp").collect()
    for part in (rows[1:], rows[:1]):
        spark.createDataFrame(part, ev.schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schemas.LIVE_TRANSACTIONS).option("maxFilesPerTrigger", "1").parquet(f"{tmpdir_fresh}/in")
    out = ST.run_to_table(spark, ST.geo_velocity_stream(stream, watermark="1 minute"), f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck")
    want = DT.geo_velocity(spark.createDataFrame(rows[1:], ev.schema))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_block_is_visible_while_active(spark, tmpdir_fresh):
    t0 = dt.datetime(2026, 1, 1)
    schema = "device_id string, blocked_at timestamp"
    for k, batch in enumerate([[("d1", t0), ("d2", t0)], [("d1", t0 + dt.timedelta(hours=20))]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmpdir_fresh}/in")
    ST.blocklist_stream(stream, "device_id", f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck").awaitTermination()

    def active(hours):
        as_of = F.lit(t0 + dt.timedelta(hours=hours)).cast("timestamp")
        return sorted(r.device_id for r in ST.live_blocklist(spark, f"{tmpdir_fresh}/out", "device_id", as_of).collect())

    assert active(21) == ["d1", "d2"] and active(30) == ["d1"] and active(50) == []


def test_antipodes_have_half_the_circumference(spark):
    r = spark.range(1).select(SC.haversine_km(F.lit(12.3456), F.lit(0.1), F.lit(-12.3456), F.lit(-179.9)).alias("d"),
                              SC.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("n")).collect()[0]
    assert 20000 < r.d < 20020 and r.n is None


def test_linked_fraud_counts_accounts_once_per_address(spark):
    g = FX.graph(spark)
    twice = KY.fraud_by_address(G.FraudGraph(
        accounts=spark.createDataFrame([("f", "Fay", G.CONFIRMED_FRAUD)], "account_id string, customer_name string, kyc_status string"),
        devices=g.devices, used_device=g.used_device, transferred=g.transferred,
        addresses=spark.createDataFrame([("1", "12 Elm St Ste A"), ("2", "12 Elm St Ste B")], "address_id string, full_address string"),
        shipped_to=spark.createDataFrame([("f", "1"), ("f", "2")], "account_id string, address_id string"))).collect()
    assert [r.n_linked_fraud for r in twice] == [1]


def test_every_failed_check_decides(spark):
    df = spark.createDataFrame([("a", True, True, False), ("b", True, True, True), ("c", False, True, False), ("d", True, None, True)],
                               "document_uri string, portrait_ok boolean, document_ok boolean, hologram_ok boolean")
    checks = {"portrait": "portrait_ok", "document": "document_ok", "hologram": "hologram_ok"}
    got = {r.document_uri: (r.decision, r.kyc_verdict, r.is_tampered, r.failed_checks) for r in KY.kyc_assess(df, checks).collect()}
    assert got == {"a": ("REJECT_HOLOGRAM", "REJECT", True, "hologram"), "b": (KY.APPROVE, "APPROVE", False, ""),
                   "c": (KY.REJECT_PORTRAIT, "REJECT", True, "portrait,hologram"), "d": (KY.REJECT_FORGED, "REJECT", True, "document")}


def test_walks_beyond_one_array(spark):
    paths = spark.createDataFrame([("a", "b", 1, 250_001), ("a", "c", 1, 1)], "origin string, destination string, hop_count int, n_paths long")
    assert G.expand_walks(paths).count() == 250_002
