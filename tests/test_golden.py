"""Golden tests on the reference's literal rows (FIXTURES.md section 1)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ringfence.functions import scalars as SC
from ringfence.operators import detectors as DT
from ringfence.operators import feeds as FD
from ringfence.operators import graph as G
from ringfence.operators import kyc as KY
from ringfence.operators import ml as ML
from ringfence.operators import scoring as SCR
from ringfence.operators import triage as TR
from ringfence.sources import io as IO

from . import fixtures as FX


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_exposure_single_account(spark):
    out = TR.exposure(FX.hist(spark), "acc_syndicate_02").collect()[0]
    assert out.txns == 1 and out.total_usd == Decimal("980.00")


def test_exposure_unknown_account_is_zero_and_null(spark):
    out = TR.exposure(FX.hist(spark), "acc_nobody").collect()[0]
    assert out.txns == 0 and out.total_usd is None


def test_features_match_hand_computed(spark):
    f = ML.fraud_features(FX.hist(spark), keep=("transaction_id",)).orderBy("transaction_id")
    got = [(r.is_emulator, r.is_high_risk, r.is_fraud) for r in f.collect()]
    assert got == [(1, 0, 1), (1, 0, 1), (1, 0, 1), (0, 0, 0), (1, 0, 1)]


def test_emulator_null_is_zero(spark):
    df = spark.createDataFrame([(None,), ("spring_device",), ("x_emulator_y",)], "d string")
    assert [r[0] for r in df.select(SC.is_emulator("d")).collect()] == [0, 1, 1]


def test_ring_excludes_self_match(spark):
    g = FX.graph(spark)
    got = rows(G.syndicate_ring(g), "account_id", "customer_name", "device_id", "full_address")
    assert got == [("acc_syndicate_02", "Alex Mercer", "dev_fp_ring_99", "104 Industrial Pkwy"),
                   ("acc_syndicate_03", "Alex Mercer", "dev_fp_ring_99", "104 Industrial Pkwy")]
    assert G.syndicate_ring(g, distinct_endpoints=False).count() == 3


def test_linked_fraud_for_target(spark):
    g = FX.graph(spark)
    t = spark.createDataFrame([("acc_syndicate_02",)], "account_id string")
    got = G.linked_fraud(g, t).collect()
    assert [(r.target, r.linked_fraud_user, r.shared_device, r.drop_address) for r in got] == [
        ("acc_syndicate_02", "Alex Mercer", "dev_fp_ring_99", "104 Industrial Pkwy")]


def test_investigation_joins_exposure(spark):
    g = FX.graph(spark)
    t = spark.createDataFrame([("acc_syndicate_02",)], "account_id string")
    out = TR.investigate(G.linked_fraud(g, t), FX.hist(spark)).collect()[0]
    assert out.txns == 1 and out.total_usd == Decimal("980.00")


def test_device_fan_in_and_ato_alert(spark):
    g = FX.graph(spark)
    accounts = g.accounts.unionByName(spark.createDataFrame(
        [("acc_legit_100", "Sarah Connor", "ACTIVE"), ("acc_legit_101", "Jordan Vance", "ACTIVE"),
         ("acc_legit_102", "Sam Lee", "ACTIVE")], g.accounts.schema))
    fan = G.device_fan_in(FX.auth(spark), accounts, "dev_fp_ring_99")
    assert fan.count() == 3
    alerts = DT.ato_fan_in(FX.auth(spark), "4 minutes", 3).collect()
    assert len(alerts) == 1 and alerts[0].n_accounts == 3


def test_transfer_paths_walk_counts(spark):
    got = rows(G.transfer_paths(FX.graph(spark), 1, 3), "origin", "destination", "hop_count", "n_paths")
    assert got == [("acc_victim_01", "acc_mule_01", 1, 1), ("acc_victim_01", "acc_mule_02", 2, 4),
                   ("acc_victim_01", "acc_offramp", 3, 4)]
    walks = G.expand_walks(G.transfer_paths(FX.graph(spark), 2, 2))
    assert walks.count() == 4


def test_smurfing_detects_four_splits(spark):
    got = DT.smurfing(FX.graph(spark).transferred, 30 * 86_400_000_000, 3).collect()
    assert len(got) == 1
    assert got[0].dst_account == "acc_mule_01" and got[0].n_splits == 4
    assert got[0].split_total == Decimal("9800.00")


def test_verdict_on_scored_rows(spark):
    sc = FX.scored(spark)
    got = dict((r.transaction_id, r.v) for r in sc.select("transaction_id", SCR.verdict(sc).alias("v")).collect())
    assert got["txn_clean_1"] == "APPROVED" and got["txn_geo_ny"] == "APPROVED"
    assert got["txn_fraud_1"] == "BLOCKED" and got["txn_bin_2"] == "BLOCKED" and got["txn_geo_lon"] == "BLOCKED"


def test_verdict_null_counts_as_false(spark):
    df = spark.createDataFrame([(None, None, None, None)],
                               "is_suspicious_device boolean, is_high_risk_amount boolean, "
                               "is_bin_attack boolean, is_impossible_travel boolean")
    assert df.select(SCR.verdict(df)).collect()[0][0] == "APPROVED"


@pytest.mark.parametrize("gap,expected", [(15, 22281), (5, 66843)])
def test_geo_velocity_ny_london(spark, gap, expected):
    out = DT.geo_velocity(FX.live(spark, gap)).filter(F.col("transaction_id") == "txn_geo_lon").collect()[0]
    assert abs(out.distance_km - 5570.23) < 0.05
    assert abs(out.calculated_speed_kmh - expected) < 5
    assert out.is_impossible_travel and out.prev_transaction_id == "txn_geo_ny"


def test_geo_velocity_first_swipe_zero_and_unlocated_skipped(spark):
    out = {r.transaction_id: r for r in DT.geo_velocity(FX.live(spark)).collect()}
    assert out["txn_clean_1"].calculated_speed_kmh == 0.0 and not out["txn_clean_1"].is_impossible_travel
    assert "txn_fraud_1" not in out


def test_geo_zero_elapsed_flags_big_jump(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", "x", t, 40.7128, -74.0060, 1.0), ("b", "x", t, 51.5074, -0.1278, 1.0)],
                               "transaction_id string, account_id string, timestamp timestamp, "
                               "latitude double, longitude double, amount double")
    out = {r.transaction_id: r for r in DT.geo_velocity(df).collect()}
    assert out["b"].calculated_speed_kmh is None and out["b"].is_impossible_travel


def test_sequential_pan(spark):
    got = rows(DT.sequential_pan(FX.live(spark)), "transaction_id", "prev_transaction_id")
    assert got == [("txn_bin_2", "txn_bin_1")]


def test_bin_velocity_rows_counts_trailing(spark):
    out = DT.bin_velocity_rows(FX.live(spark), 60 * 1_000_000, 2.0, 2).collect()
    assert [(r.transaction_id, r.n_attempts) for r in out] == [("txn_bin_2", 2)]


def test_spend_spike_excludes_current_and_same_instant(spark):
    t = dt.datetime(2026, 1, 1)
    d = dt.timedelta(days=1)
    df = spark.createDataFrame([
        ("1", "a", 10.0, t), ("2", "a", 10.0, t + d), ("3", "a", 600.0, t + 2 * d), ("4", "a", 600.0, t + 2 * d),
        ("5", "b", 999.0, t)], "transaction_id string, account_id string, amount double, timestamp timestamp")
    got = rows(DT.spend_spike(df, 90, 30.0), "transaction_id", "baseline_n")
    assert got == [("3", 2), ("4", 2)]


def test_dormant_bust_out(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("1", "a", 5.0, t), ("2", "a", 2000.0, t + dt.timedelta(days=40)),
                                ("3", "a", 3000.0, t + dt.timedelta(days=41))],
                               "transaction_id string, account_id string, amount double, timestamp timestamp")
    got = rows(DT.dormant_bust_out(df, 30 * 86_400_000_000, 1000.0), "transaction_id")
    assert got == [("2",)]


def test_kyc_decisions_and_verdict(spark):
    a = KY.kyc_assess(FX.kyc(spark))
    got = rows(a, "applicant_name", "decision", "kyc_verdict", "is_tampered")
    assert got == [("JORDAN VANCE", "REJECT_FORGED_ID", "REJECT", True),
                   ("MARCUS VANCE", "REJECT_DEEPFAKE_PORTRAIT", "REJECT", True),
                   ("SARAH JENKINS", "APPROVE", "APPROVE", False)]
    summ = {r.decision: r.n_documents for r in KY.kyc_summary(a).collect()}
    assert summ == {"REJECT_FORGED_ID": 1, "REJECT_DEEPFAKE_PORTRAIT": 1, "APPROVE": 1}


def test_kyc_graph_link_by_normalised_address(spark):
    out = {r.applicant_name: r for r in KY.kyc_graph_link(FX.kyc(spark), FX.graph(spark)).collect()}
    assert out["JORDAN VANCE"].n_linked_fraud == 1
    assert out["JORDAN VANCE"].graph_syndicate_link.startswith("Direct Link to Alex Mercer")
    assert out["SARAH JENKINS"].graph_syndicate_link == KY.NO_LINK


def test_unified_feed_auth_rows(spark):
    u = FD.unified_feed(FX.live(spark), FX.auth(spark))
    auth_rows = u.filter(F.col("channel") == "MOBILE_AUTH").collect()
    assert len(auth_rows) == 3 and all(r.amount == 0.0 and r.bin == "N/A" for r in auth_rows)
    assert sorted(r.merchant_category for r in auth_rows) == [
        "auth_2fa_phone_change", "auth_password_reset", "auth_password_reset"]
    assert u.count() == 12


def test_raw_feed_defaults_and_latest(spark):
    f = FD.raw_feed(FD.latest(FX.live(spark), "timestamp", 5, "transaction_id")).collect()
    assert len(f) == 5 and f[0].transaction_id == "txn_live_901"
    assert f[0].bin == "N/A" and f[0].channel == "POS"


def test_scalar_formats(spark):
    df = spark.createDataFrame([(1234.5, 0.992, "4111111111111029", "198.51.100.24", -12.0)],
                               "a double, r double, pan string, ip string, neg double")
    r = df.select(SC.money_text("a"), SC.percent_text("r"), SC.card_bin("pan"), SC.mask_pan("pan"),
                  SC.last4_display("pan"), SC.ipv4_subnet("ip"), SC.money_text("neg")).collect()[0]
    assert list(r) == ["$1,234.50", "99.2%", "411111", "411111******1029", "•••• •••• •••• 1029",
                       "198.51.100", "-$12.00"]


def test_auth_category_and_address_key(spark):
    df = spark.createDataFrame([("PASSWORD_RESET", "104 Industrial Pkwy"),
                                ("2FA_PHONE_CHANGED", "104 Industrial Pkwy Ste B, Wilmington DE")],
                               "e string, a string")
    got = df.select(SC.auth_category("e"), SC.normalize_address("a")).collect()
    assert [x[0] for x in got] == ["auth_password_reset", "auth_2fa_phone_change"]
    assert got[0][1] == got[1][1] == "104 INDUSTRIAL PKWY"


def test_parse_ts_bad_text_is_null(spark):
    df = spark.createDataFrame([("2024-01-15 10:20:00",), ("not a time",)], "s string")
    got = [r[0] for r in df.select(SC.parse_ts("s")).collect()]
    assert got[0] is not None and got[1] is None


def test_evidence_list(spark):
    df = spark.createDataFrame([(True, False, None)], "a boolean, b boolean, c boolean")
    ev = df.select(SC.evidence((F.col("a"), "A", "da"), (F.col("b"), "B", "db"), (F.col("c"), "C", "dc"))).collect()[0][0]
    assert [(e.heading, e.detail) for e in ev] == [("A", "da")]


def test_containment_actions_and_holds(spark):
    sc = spark.createDataFrame([("t1", "a", "SYNDICATE", "BLOCKED"), ("t2", "b", "CLEAN", "APPROVED")],
                               "transaction_id string, account_id string, vector string, verdict string")
    acts = rows(TR.containment_actions(sc, SCR.policy_table(spark)), "transaction_id", "action_seq", "action")
    assert acts == [("t1", 0, "TEMPORARY_CARD_FREEZE"), ("t1", 1, "SMS_TWO_WAY_VERIFICATION")]
    t = dt.datetime(2026, 1, 1)
    holds = spark.createDataFrame([("h1", "a", 10.0), ("h2", "a", 20.0), ("h3", "b", 30.0)],
                                  "hold_id string, account_id string, amount double")
    replies = spark.createDataFrame([("h1", "2", t), ("h1", "1", t + dt.timedelta(minutes=1)), ("h2", "2", t)],
                                    "hold_id string, reply string, replied_at timestamp")
    res = {r.hold_id: r.status for r in TR.resolve_holds(holds, replies).collect()}
    assert res == {"h1": "RELEASED", "h2": "BLOCKED_PERMANENT", "h3": "PENDING"}
    fp = TR.false_positive_rate(TR.resolve_holds(holds, replies)).collect()[0]
    assert fp.n_blocked == 3 and fp.n_false_positive == 1
    ie = {r.account_id: r.pending_amount for r in TR.incident_exposure(TR.resolve_holds(holds, replies)).collect()}
    assert ie == {"a": Decimal("0.00"), "b": Decimal("30.00")}


def test_screen_blocklist_ttl(spark):
    t = dt.datetime(2026, 1, 1)
    h = dt.timedelta(hours=1)
    txns = spark.createDataFrame([("e1", "198.51.100", t + h), ("e2", "198.51.100", t + 25 * h),
                                  ("e3", "10.0.0", t + h)],
                                 "transaction_id string, subnet string, timestamp timestamp")
    blocks = spark.createDataFrame([("198.51.100", t)], "subnet string, blocked_at timestamp")
    got = rows(TR.screen_blocklist(txns, blocks, "subnet"), "transaction_id", "is_blocked")
    assert got == [("e1", True), ("e2", False), ("e3", False)]
    active = TR.active_blocklist(blocks, "subnet", F.lit(t + 2 * h)).collect()
    assert [r.subnet for r in active] == ["198.51.100"]


def test_risk_level_cutoffs(spark):
    df = spark.createDataFrame([(0.4,), (96.8,), (98.9,), (99.7,)], "s double")
    assert [r[0] for r in df.select(SCR.risk_level("s")).collect()] == ["Low", "High", "Critical", "Critical"]


def test_modernize_roundtrip_and_conform(spark, tmpdir_fresh):
    from ringfence import schemas

    IO.modernize(FX.hist(spark), f"{tmpdir_fresh}/hist")
    IO.modernize(FX.hist(spark), f"{tmpdir_fresh}/hist")  # create-or-replace, not append
    back = IO.parse_legacy_timestamp(IO.read_transactions(spark, f"{tmpdir_fresh}/hist"))
    assert back.count() == 5 and dict(back.dtypes)["timestamp"] == "timestamp_ntz"
    IO.register_archive(spark, f"{tmpdir_fresh}/hist", "hist_archive")
    assert spark.sql("SELECT COUNT(*) FROM hist_archive").collect()[0][0] == 5
    part = spark.createDataFrame([("x", "a", 1.0)], "transaction_id string, account_id string, amount double")
    IO.append_conformed(part, schemas.LIVE_TRANSACTIONS, f"{tmpdir_fresh}/live")
    IO.append_conformed(part, schemas.LIVE_TRANSACTIONS, f"{tmpdir_fresh}/live")
    live = spark.read.schema(schemas.LIVE_TRANSACTIONS).parquet(f"{tmpdir_fresh}/live")
    assert live.count() == 2 and live.filter(F.col("channel").isNull()).count() == 2


def test_investigation_actions_follow_the_data(spark):
    g = FX.graph(spark)
    t = spark.createDataFrame([("acc_syndicate_02",), ("acc_legit_100",)], "account_id string")
    acts = TR.investigation_actions(TR.investigate(G.linked_fraud(g, t), FX.hist(spark))).collect()
    assert [(r.target, r.action, r.n_links, r.total_usd) for r in acts] == [
        ("acc_syndicate_02", "TEMPORARY_CARD_FREEZE", 1, Decimal("980.00"))]
