"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each function reads the driver's tables through ``sources.testdata`` and
the whole tables. ``plans/oracle.py`` holds the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as SCH
from ..functions import scalars as SC
from ..operators import detectors as DT
from ..operators import feeds as FD
from ..operators import graph as G
from ..operators import kyc as KY
from ..operators import ml as ML
from ..operators import scoring as SCR
from ..operators import triage as TR
from ..operators.sliced import DAY_US, HOUR_US
from ..session import ensure_checkpoint_dir, materialize, scratch_path
from ..sources import io as IO
from ..sources import testdata as td
from ..streaming import streams as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- graph

@register("ring_4hop")
def q_ring_4hop(spark, sf_dir):
    return G.syndicate_ring(td.graph(spark, sf_dir), distinct_endpoints=True)


@register("ring_4hop_walk")
def q_ring_4hop_walk(spark, sf_dir):
    return G.syndicate_ring(td.graph(spark, sf_dir), distinct_endpoints=False)


@register("linked_fraud_exposure")
def q_linked_fraud_exposure(spark, sf_dir):
    g = td.graph(spark, sf_dir)
    return TR.investigate(G.linked_fraud(g), td.historical_transactions(spark, sf_dir))


@register("exposure_by_account")
def q_exposure_by_account(spark, sf_dir):
    return TR.exposure_by_account(td.historical_transactions(spark, sf_dir))


@register("transfer_paths")
def q_transfer_paths(spark, sf_dir):
    return G.transfer_paths(td.graph(spark, sf_dir), lo=1, hi=3)


# ------------------------------------------------------------ detectors
# Wider parameters than the reference's literals (4 minutes, 80/s, 30x):
# the driver's events are sparse, see FIXTURES.md section 2.

@register("spend_spike")
def q_spend_spike(spark, sf_dir):
    return DT.spend_spike(td.transactions(spark, sf_dir), days=90, factor=Decimal("5.0"))


@register("geo_velocity")
def q_geo_velocity(spark, sf_dir):
    return DT.geo_velocity(td.transactions(spark, sf_dir), max_kmh=900.0)


@register("bin_velocity_rows")
def q_bin_velocity_rows(spark, sf_dir):
    return DT.bin_velocity_rows(td.transactions(spark, sf_dir), 24 * HOUR_US, 10.0, 3)


@register("ato_fan_in_rows")
def q_ato_fan_in_rows(spark, sf_dir):
    return DT.ato_fan_in_rows(td.auth_events(spark, sf_dir), 12 * HOUR_US, 3)


@register("dormant_bust_out")
def q_dormant_bust_out(spark, sf_dir):
    return DT.dormant_bust_out(td.transactions(spark, sf_dir), 2 * DAY_US, 50.0)


@register("sequential_pan")
def q_sequential_pan(spark, sf_dir):
    return DT.sequential_pan(td.transactions(spark, sf_dir))


@register("ato_fan_in")
def q_ato_fan_in(spark, sf_dir):
    return DT.ato_fan_in(td.auth_events(spark, sf_dir), "1 day", 3)


@register("bin_velocity")
def q_bin_velocity(spark, sf_dir):
    return DT.bin_velocity(td.transactions(spark, sf_dir), "1 day", 10.0, 3)


@register("subnet_spread")
def q_subnet_spread(spark, sf_dir):
    return DT.subnet_spread(td.transactions(spark, sf_dir), "1 day")


@register("smurfing")
def q_smurfing(spark, sf_dir):
    return DT.smurfing(td.graph(spark, sf_dir).transferred, 30 * DAY_US, 3)


# ------------------------------------------------------------ scoring


P = SCR.TESTDATA_PARAMS


def scored(spark, sf_dir):
    """R6 over the stand-in stream (processed_at = event time + k seconds)."""
    txns = td.with_processed_at(td.transactions(spark, sf_dir))
    return SCR.score_batch(spark, txns, td.devices(spark, sf_dir), P, processed_at="processed_at",
                           auth=td.auth_events(spark, sf_dir))


def resolved_holds(spark, sf_dir):
    sc = scored(spark, sf_dir)
    holds = sc.filter(F.col("verdict") == "BLOCKED").select(
        F.col("transaction_id").alias("hold_id"), "account_id", "amount", "vector")
    replies = td.cardholder_replies(td.transactions(spark, sf_dir), holds)
    return TR.resolve_holds(holds, replies)


@register("verdict")
def q_verdict(spark, sf_dir):
    f = SCR.flags(td.transactions(spark, sf_dir), td.devices(spark, sf_dir), P)
    return f.select("transaction_id", "is_suspicious_device", "is_high_risk_amount",
                    "is_bin_attack", "is_impossible_travel", SCR.verdict().alias("verdict"))


@register("score_batch")
def q_score_batch(spark, sf_dir):
    return scored(spark, sf_dir)


@register("row_class")
def q_row_class(spark, sf_dir):
    latest_ids = FD.latest(td.transactions(spark, sf_dir), "timestamp", 100, tie="transaction_id")
    m = SCR.mark_new(scored(spark, sf_dir), latest_ids.select("transaction_id"))
    return m.select("transaction_id", "verdict", "is_new", SCR.row_class(m).alias("row_class"))


@register("raw_feed_latest")
def q_raw_feed_latest(spark, sf_dir):
    return FD.raw_feed(FD.latest(td.transactions(spark, sf_dir), "timestamp", 5, tie="transaction_id"))


@register("scored_feed_latest")
def q_scored_feed_latest(spark, sf_dir):
    return FD.scored_feed(FD.latest(scored(spark, sf_dir), "processed_at", 5, tie="transaction_id"))


@register("unified_feed")
def q_unified_feed(spark, sf_dir):
    card = td.transactions(spark, sf_dir).filter(~F.col("merchant_category").isin(*td.AUTH_EVENT_TYPES))
    return FD.unified_feed(card, td.auth_events(spark, sf_dir))


@register("enrich")
def q_enrich(spark, sf_dir):
    g = td.graph(spark, sf_dir)
    t = td.transactions(spark, sf_dir).select("transaction_id", "account_id", "device_id", "amount")
    return TR.enrich(t, g.accounts, g.devices)


@register("screen_blocklist")
def q_screen_blocklist(spark, sf_dir):
    t = td.transactions(spark, sf_dir).select("transaction_id", "device_id", "timestamp")
    out = TR.screen_blocklist(t, td.blocks(spark, sf_dir), "device_id", 24 * HOUR_US)
    return out.filter("is_blocked").select("transaction_id", "device_id", "n_active_blocks")


@register("screen_subnet_blocks")
def q_screen_subnet_blocks(spark, sf_dir):
    """R7 -> R8 -> J6: transactions on a subnet that a BIN attack got blocked
    in the 24 hours before."""
    t = materialize(td.transactions(spark, sf_dir).select("transaction_id", "ip_address", "timestamp"), "subnet-rows")
    sc = materialize(scored(spark, sf_dir).select("transaction_id", "account_id", "verdict", "vector", "processed_at"), "scored")
    blocks = materialize(TR.subnet_blocks(TR.containment_actions(sc, SCR.policy_table(spark)), sc, t), "subnet-blocks")
    rows = t.select("transaction_id", SC.ipv4_subnet("ip_address").alias("subnet"), "timestamp")
    out = TR.screen_blocklist(rows, blocks, "subnet", 24 * HOUR_US)
    return out.filter("is_blocked").select("transaction_id", "subnet", "n_active_blocks")


@register("active_blocklist")
def q_active_blocklist(spark, sf_dir):
    as_of = td.table(spark, sf_dir, "events").select(F.max("ts")).scalar()
    return TR.active_blocklist(td.blocks(spark, sf_dir), "device_id", as_of, 24 * HOUR_US)


@register("containment_actions")
def q_containment_actions(spark, sf_dir):
    return TR.containment_actions(scored(spark, sf_dir), SCR.policy_table(spark))


@register("resolve_holds")
def q_resolve_holds(spark, sf_dir):
    return resolved_holds(spark, sf_dir)


@register("false_positive_rate")
def q_false_positive_rate(spark, sf_dir):
    return TR.false_positive_rate(resolved_holds(spark, sf_dir))


@register("incident_exposure")
def q_incident_exposure(spark, sf_dir):
    return TR.incident_exposure(resolved_holds(spark, sf_dir))


@register("prevented_by_day")
def q_prevented_by_day(spark, sf_dir):
    return TR.prevented_by_day(scored(spark, sf_dir))


@register("decision_latency")
def q_decision_latency(spark, sf_dir):
    return TR.decision_latency(td.transactions(spark, sf_dir), scored(spark, sf_dir))


@register("decision_latency_percentiles")
def q_decision_latency_percentiles(spark, sf_dir):
    return TR.decision_latency_percentiles(td.transactions(spark, sf_dir), scored(spark, sf_dir))


@register("triage_dossier")
def q_triage_dossier(spark, sf_dir):
    g = td.graph(spark, sf_dir)
    pairs = G.ring_matches(g, G.fraud_seeds(g), distinct_endpoints=True)
    kyc = KY.kyc_assess(td.kyc_checks(spark, sf_dir)).select("account_id", "kyc_verdict")
    d = TR.triage_dossier(scored(spark, sf_dir), pairs, td.historical_transactions(spark, sf_dir), kyc)
    text = F.transform("evidence", lambda e: F.concat_ws(": ", e["heading"], e["detail"]))
    return d.withColumn("evidence", F.array_join(text, "; "))


# ------------------------------------------------------------ KYC

def kyc_docs(spark, sf_dir):
    """Check results with the extracted address text (supplier name)."""
    addr = td.graph(spark, sf_dir).addresses.select(
        "address_id", F.col("full_address").alias("extracted_address"))
    return td.kyc_checks(spark, sf_dir).join(addr, "address_id", "left")


@register("kyc_assess")
def q_kyc_assess(spark, sf_dir):
    return KY.kyc_assess(td.kyc_checks(spark, sf_dir)).select(
        "document_uri", "is_tampered", "failed_checks", "decision", "kyc_verdict")


@register("kyc_graph_link")
def q_kyc_graph_link(spark, sf_dir):
    out = KY.kyc_graph_link(kyc_docs(spark, sf_dir), td.graph(spark, sf_dir))
    return out.select("document_uri", "extracted_address", "n_linked_fraud", "graph_syndicate_link")


@register("kyc_summary")
def q_kyc_summary(spark, sf_dir):
    return KY.kyc_summary(KY.kyc_assess(td.kyc_checks(spark, sf_dir)))


# ------------------------------------------------------------ graph extras

@register("graph_violations")
def q_graph_violations(spark, sf_dir):
    t = lambda n: td.table(spark, sf_dir, n)
    return G.graph_violations([
        G.key_violations(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"),
        G.key_violations(t("customer"), ["c_custkey"], "customer"),
        G.key_violations(t("part"), ["p_partkey"], "part"),
        G.key_violations(t("supplier"), ["s_suppkey"], "supplier"),
        G.key_violations(t("orders"), ["o_orderkey"], "orders"),
        G.dangling_refs(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders"),
        G.dangling_refs(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem"),
        G.dangling_refs(t("lineitem"), "l_partkey", t("part"), "p_partkey", "lineitem"),
        G.dangling_refs(t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey", "lineitem"),
    ])


@register("shared_device_pairs")
def q_shared_device_pairs(spark, sf_dir):
    g = td.graph(spark, sf_dir)
    seeds = G.fraud_seeds(g).select(F.col("fraud_id").alias("account_id"))
    return G.shared_device_pairs(g, seeds, emulator_only=True)


@register("blast_radius")
def q_blast_radius(spark, sf_dir):
    return G.blast_radius(td.graph(spark, sf_dir), emulator_only=True)


@register("blast_radius_members")
def q_blast_radius_members(spark, sf_dir):
    """The accounts of each emulator device in pages of about eight."""
    m = G.blast_radius_members(td.graph(spark, sf_dir), emulator_only=True, page_size=8)
    return m.select("device_id", "n_pages", "page", F.size("members").cast("long").alias("n_members"),
                    F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@register("investigate_targets")
def q_investigate_targets(spark, sf_dir):
    """G4 + A1 anchored: the accounts that ran an emulator device with an
    error are the targets; expansion starts from them."""
    g = td.graph(spark, sf_dir)
    targets = td.transactions(spark, sf_dir).filter((F.col("merchant_category") == "error") & (F.col("amount") > 100)).select("account_id")
    return TR.investigate(G.linked_fraud(g, targets), td.historical_transactions(spark, sf_dir))


@register("account_exposure")
def q_account_exposure(spark, sf_dir):
    """A1 + P4: the exposure of one account, the one of the newest event."""
    newest = td.table(spark, sf_dir, "events").select(F.max_by("user_id", F.struct("ts", "event_id"))).scalar()
    return TR.exposure(td.historical_transactions(spark, sf_dir), newest)


@register("commercial_drop_links")
def q_commercial_drop_links(spark, sf_dir):
    """Fraud accounts at each commercial drop address."""
    return G.commercial_drop_links(td.graph(spark, sf_dir))


@register("device_fan_in")
def q_device_fan_in(spark, sf_dir):
    g = td.graph(spark, sf_dir)
    anchors = g.devices.filter(F.col("is_emulator")).select("device_id")
    return G.device_fan_in(td.auth_events(spark, sf_dir), g.accounts, anchors)


# ------------------------------------------------------------ scalars

@register("scalar_formats")
def q_scalar_formats(spark, sf_dir):
    s = td.scalar_inputs(spark, sf_dir)
    return s.select(
        "c_custkey",
        SC.money_text("c_acctbal").alias("balance_text"),
        SC.percent_text("ratio").alias("ratio_text"),
        SC.card_bin("pan").alias("card_bin"),
        SC.mask_pan("pan").alias("pan_masked"),
        SC.last4_display("pan").alias("pan_display"),
        SC.ipv4_subnet("ip_address").alias("subnet"),
        F.coalesce(F.col("c_mktsegment"), F.lit("UNKNOWN")).alias("segment"),
        F.col("c_mktsegment").contains("BUILD").alias("is_building"),
    )


# ------------------------------------------------------------ sources / sinks


@register("modernize_roundtrip")
def q_modernize_roundtrip(spark, sf_dir):
    """S1-S3 + F10: land the archive (text timestamps) as an overwrite, expose
    it under a name, read it back with the declared schema and type the
    timestamp."""
    ensure_checkpoint_dir(spark)
    hist = td.historical_transactions(spark, sf_dir).select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("account_id").cast("string").alias("account_id"),
        "amount", "merchant_category",
        F.lit(None).cast("string").alias("device_id"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    path = scratch_path(spark, "archive")
    IO.modernize(hist, path)
    IO.register_archive(spark, path, "historical_transactions")
    return IO.parse_legacy_timestamp(IO.read_transactions(spark, path))


@register("conform_append")
def q_conform_append(spark, sf_dir):
    """Append partial rows to the live stream table; absent columns NULL."""
    ensure_checkpoint_dir(spark)
    ev = td.table(spark, sf_dir, "events")
    part = ev.select(F.col("event_id").cast("string").alias("transaction_id"),
                     F.col("user_id").cast("string").alias("account_id"),
                     F.col("value").alias("amount"), F.col("event_type").alias("merchant_category"),
                     td.prop_k().cast("string").alias("device_id"),
                     F.col("ts").cast("timestamp").alias("timestamp"))
    path = scratch_path(spark, "live")
    IO.append_conformed(part, SCH.LIVE_TRANSACTIONS, path)
    out = spark.read.schema(SCH.LIVE_TRANSACTIONS).parquet(path)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("document_manifest")
def q_document_manifest(spark, sf_dir):
    """Manifest of the documents table: where each is and how large."""
    return td.document_manifest(spark, sf_dir)


# ------------------------------------------------------------ ML

def feature_table(spark, sf_dir):
    """M1 over order lines: device = part name, category = part type,
    label = the buyer is a confirmed fraud account."""
    lines = td.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = td.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    cust = td.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    hist = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(part, lines.l_partkey == part.p_partkey)
            .join(cust, orders.o_custkey == cust.c_custkey)
            .select("l_orderkey", "l_partkey", F.col("l_extendedprice").alias("amount"),
                    F.col("p_name").alias("device_id"), F.col("p_type").alias("merchant_category"),
                    (F.col("c_acctbal") < td.FRAUD_BALANCE).alias("label")))
    return ML.fraud_features(hist, label=F.col("label"), keep=("l_orderkey", "l_partkey"))


@register("fraud_features")
def q_fraud_features(spark, sf_dir):
    return feature_table(spark, sf_dir)


@register("predict")
def q_predict(spark, sf_dir):
    """M2 + M3: train the boosted-tree classifier on four fifths of the rows,
    score the others."""
    seen, held = ML.split(materialize(feature_table(spark, sf_dir), "features"), "l_orderkey")
    model = ML.train_classifier(seen, max_iter=10)
    return ML.predict(model, held, keep=("l_orderkey", "l_partkey", "is_fraud"))


@register("predict_rows")
def q_predict_rows(spark, sf_dir):
    """The rows that ``predict`` scores, with their labels: what of M2/M3 is
    the same for any trained model."""
    _, held = ML.split(feature_table(spark, sf_dir), "l_orderkey")
    return held.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_fraud").cast("long").alias("n_fraud"))


@register("train_classifier")
def q_train_classifier(spark, sf_dir):
    """M2 + M3 evaluation: ROC / PR area on the held-out rows."""
    seen, held = ML.split(materialize(feature_table(spark, sf_dir), "features"), "l_orderkey")
    return ML.evaluate(ML.train_classifier(seen, max_iter=10), held)


# ------------------------------------------------------------ streaming

def _stream_txns(spark, sf_dir):
    return ST.event_time(td.transactions(spark, sf_dir, td.events_stream(spark, sf_dir)))


def _run_at(spark, df, base):
    return ST.run_to_table(spark, df, f"{base}/out", f"{base}/checkpoint")


def _run(spark, df, name):
    ensure_checkpoint_dir(spark)
    return _run_at(spark, df, scratch_path(spark, name))


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """R1 + S4 + S8: stateless scoring with a stream-static device join."""
    s = ST.score_stateless(_stream_txns(spark, sf_dir), td.devices(spark, sf_dir), P.high_risk_amount)
    out = _run(spark, s, "stream-score")
    return out.select("transaction_id", "account_id", "amount", "is_suspicious_device", "is_high_risk_amount")


@register("stream_bin")
def q_stream_bin(spark, sf_dir):
    """R2: sliding 1-day windows every 12 hours, micro amounts up to 10; a
    sentinel row closes the last windows."""
    ensure_checkpoint_dir(spark)
    txns = _stream_txns(spark, sf_dir).select("card_bin", "amount", "timestamp")
    txns = ST.with_sentinel(txns, scratch_path(spark, "sentinel-bin"), amount=0.0, card_bin="sentinel")
    s = ST.bin_attack_stream(txns, "1 day", "12 hours", "1 hour", 10.0, 3)
    return _ntz(_run(spark, s, "stream-bin"), "window_start", "window_end")


@register("stream_ato")
def q_stream_ato(spark, sf_dir):
    """R3 + S5: distinct accounts per device per day from the auth stream; a
    sentinel row closes the last windows."""
    ensure_checkpoint_dir(spark)
    auth = ST.event_time(td.auth_events(spark, sf_dir, td.events_stream(spark, sf_dir))).select("account_id", "device_id", "timestamp")
    s = ST.ato_stream(ST.with_sentinel(auth, scratch_path(spark, "sentinel-ato")), "1 day", "1 hour", 3)
    return _ntz(_run(spark, s, "stream-ato"), "window_start", "window_end")


@register("stream_geo")
def q_stream_geo(spark, sf_dir):
    """Geo-velocity over the transaction stream in event-time order."""
    ensure_checkpoint_dir(spark)
    return _run(spark, ST.geo_velocity_stream(_stream_txns(spark, sf_dir), 900.0, 100.0, "1 hour", state_buckets=8), "stream-geo")


@register("stream_spike")
def q_stream_spike(spark, sf_dir):
    """Events after a cut-off against the profile of the 90 days before it
    (stream-static join); no event is part of its own profile."""
    from ..operators.triage import MONEY

    cut = F.lit(td.PROFILE_CUTOFF).cast("timestamp")
    past = td.transactions(spark, sf_dir).filter((F.col("timestamp") < cut) & (F.col("timestamp") >= cut - F.expr("INTERVAL 90 DAYS")))
    profile = past.groupBy("account_id").agg(F.count(F.lit(1)).alias("baseline_n"),
                                             F.sum(F.col("amount").cast(MONEY)).alias("baseline_total"))
    s = ST.spike_stream(_stream_txns(spark, sf_dir).filter(F.col("timestamp") >= cut), profile, 5.0)
    out = _run(spark, s, "stream-spike")
    return out.withColumn("baseline_total", F.col("baseline_total").cast("decimal(38,2)"))


@register("stream_spike_profile")
def q_stream_spike_profile(spark, sf_dir):
    """R5 + S4 with the profile kept by the stream: 10 whole days before an
    event's day, 5 times the mean; the feed lands in three parts by time."""
    from ..streaming import profiles as PR

    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "stream-spike-profile")
    txns = td.transactions(spark, sf_dir)
    one = F.lit(td.PROFILE_CUTOFF).cast("timestamp_ntz")
    two, t = one + F.expr("INTERVAL 7 DAYS"), F.col("timestamp")
    for part in (t < one, (t >= one) & (t < two), t >= two):
        IO.append_conformed(txns.filter(part), SCH.LIVE_TRANSACTIONS, f"{base}/txn")
        q = PR.spike_profile_stream(IO.read_txn_stream(spark, f"{base}/txn"), base, f"{base}/checkpoint", 10, 5.0, 3, state_buckets=8)
        q.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch_id")
    return _ntz(out, "timestamp")


@register("stream_blocklist")
def q_stream_blocklist(spark, sf_dir):
    """R8 streaming: the blocks active at the newest event."""
    ensure_checkpoint_dir(spark)
    ev = td.events_stream(spark, sf_dir)
    blocks = (ev.filter((F.col("event_type") == "error") & (F.col("value") > 200))
              .select(td.prop_k().alias("device_id"), F.col("ts").cast("timestamp").alias("blocked_at")))
    base = scratch_path(spark, "stream-blocklist")
    q = ST.blocklist_stream(blocks, "device_id", f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    as_of = td.table(spark, sf_dir, "events").select(F.max("ts").cast("timestamp")).scalar()
    return _ntz(ST.live_blocklist(spark, f"{base}/out", "device_id", as_of), "last_blocked_at", "expires_at")


@register("stream_scored")
def q_stream_scored(spark, sf_dir):
    """R6 on a stream: micro-batches scored with landed history; verdicts of
    all transactions (takeover events are another stream's)."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "stream-scored")
    q = ST.score_stream(_stream_txns(spark, sf_dir).drop("k"), f"{base}/out", f"{base}/checkpoint", td.devices(spark, sf_dir), P,
                        state_buckets=8)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("transaction_id", "account_id", "is_bin_attack", "is_impossible_travel", "is_spend_spike",
                                                    "is_dormant_bust_out", "verdict")


@register("stream_scored_ato")
def q_stream_scored_ato(spark, sf_dir):
    """R6 + S4 + S5 on two streams, in two runs from one checkpoint: the first
    finds the transactions up to a cut-off and the authentication events up to
    two days before it, the second the rest. Fan-ins that come late mark
    transactions that were scored before."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "stream-scored-ato")
    txns, auth = td.transactions(spark, sf_dir), td.auth_events(spark, sf_dir)
    cut = F.lit(td.PROFILE_CUTOFF).cast("timestamp_ntz")
    early = cut - F.expr("INTERVAL 2 DAYS")
    for txn_part, auth_part in (((F.col("timestamp") < cut), (F.col("timestamp") < early)),
                                ((F.col("timestamp") >= cut), (F.col("timestamp") >= early))):
        IO.append_conformed(txns.filter(txn_part), SCH.LIVE_TRANSACTIONS, f"{base}/txn")
        IO.append_conformed(auth.filter(auth_part), SCH.AUTH_EVENTS, f"{base}/auth")
        dev = td.devices(spark, sf_dir).withColumn("device_id", F.col("device_id").cast("string"))
        q = ST.score_stream(IO.read_txn_stream(spark, f"{base}/txn"), f"{base}/out", f"{base}/checkpoint", dev, P,
                            auth=IO.read_auth_stream(spark, f"{base}/auth"), state_buckets=8)
        q.awaitTermination()
    return ST.current_scores(spark, f"{base}/out").select("transaction_id", "account_id", "is_bin_attack", "is_impossible_travel", "is_spend_spike",
                                                          "is_dormant_bust_out", "is_ato", "verdict", "vector")


@register("stream_replays")
def q_stream_replays(spark, sf_dir):
    """A feed that is delivered again after the first run has ended; the
    second run, from the same checkpoint, drops every replay."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "stream-replays")
    txns = td.transactions(spark, sf_dir)
    for _ in range(2):
        IO.append_conformed(txns, SCH.LIVE_TRANSACTIONS, f"{base}/in")
        s = ST.dedupe_replays(IO.read_txn_stream(spark, f"{base}/in"), watermark="1 hour")
        out = _run_at(spark, s, base)
    return _ntz(out.select("transaction_id", "account_id", "amount", "timestamp"), "timestamp")


@register("stream_holds")
def q_stream_holds(spark, sf_dir):
    """J8 on streams: holds and replies land as files; each hold comes out with
    its outcome. Sentinel rows end both streams."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "stream-holds")
    txns = td.transactions(spark, sf_dir)
    blocked = materialize(scored(spark, sf_dir).filter(F.col("verdict") == "BLOCKED").select(
        F.col("transaction_id").alias("hold_id"), "account_id", "amount", "vector"), "holds")  # read twice below
    held = blocked.join(txns.select(F.col("transaction_id").alias("hold_id"), F.col("timestamp").alias("held_at")), "hold_id")
    IO.append_conformed(held, SCH.HOLDS, f"{base}/holds")
    IO.append_conformed(td.cardholder_replies(txns, blocked), SCH.CARDHOLDER_REPLIES, f"{base}/replies")
    holds = ST.with_sentinel(IO.read_stream(spark, f"{base}/holds", SCH.HOLDS), f"{base}/sentinel-holds", "held_at", hold_id="sentinel")
    replies = ST.with_sentinel(IO.read_stream(spark, f"{base}/replies", SCH.CARDHOLDER_REPLIES), f"{base}/sentinel-replies", "replied_at",
                               hold_id="sentinel")
    out = _run_at(spark, ST.resolve_holds_stream(holds, replies, "90 days", "1 hour"), base)  # the sentinel hold stays open
    return _ntz(out.drop("held_at"), "replied_at")


@register("bin_velocity_episodes")
def q_bin_velocity_episodes(spark, sf_dir):
    """W3 with episode flagging: every attempt of a triggering burst."""
    return DT.bin_velocity_rows(td.transactions(spark, sf_dir), 24 * HOUR_US, 10.0, 3, episode=True)


@register("ato_fan_in_episodes")
def q_ato_fan_in_episodes(spark, sf_dir):
    """W4 with episode flagging: every auth event of a fan-in."""
    return DT.ato_fan_in_rows(td.auth_events(spark, sf_dir), 12 * HOUR_US, 3, episode=True)


@register("kyc_audit_latest")
def q_kyc_audit_latest(spark, sf_dir):
    """M4 + J3 + S9 + S10 + P3/T3: assess and link every document, append the
    audit rows, scan the log back and show the latest five. The stand-in scan
    time is 2024-01-01 plus doc_id seconds (labels carry no time)."""
    ensure_checkpoint_dir(spark)
    g = td.graph(spark, sf_dir)
    docs = KY.kyc_graph_link(KY.kyc_assess(kyc_docs(spark, sf_dir)), g)
    audit = docs.select(
        "document_uri",
        F.concat(F.lit("APPLICANT-"), F.col("doc_id").cast("string")).alias("applicant_name"),
        "extracted_address", "is_tampered",
        "confidence_score",
        F.col("failed_checks").alias("forensic_analysis"),
        "graph_syndicate_link", "decision",
        F.expr("timestampadd(SECOND, doc_id, TIMESTAMP '2024-01-01 00:00:00')").alias("scanned_at"))
    path = scratch_path(spark, "kyc-audit-log")
    IO.append_kyc_audit(audit, path)
    log = IO.read_kyc_audit(spark, path)
    return FD.kyc_feed(FD.latest(log, "scanned_at", 5, tie="document_uri"))


@register("investigation_actions")
def q_investigation_actions(spark, sf_dir):
    """G4 + A1 + action: every account investigated; a freeze action only
    for accounts linked to a confirmed fraudster."""
    g = td.graph(spark, sf_dir)
    inv = TR.investigate(G.linked_fraud(g), td.historical_transactions(spark, sf_dir))
    return TR.investigation_actions(inv)


@register("mark_new")
def q_mark_new(spark, sf_dir):
    """P12 alone: the latest batch of 100 transaction ids marked new."""
    t = td.transactions(spark, sf_dir)
    latest_ids = FD.latest(t, "timestamp", 100, tie="transaction_id").select("transaction_id")
    return SCR.mark_new(t.select("transaction_id", "account_id"), latest_ids)


@register("classify_vector")
def q_classify_vector(spark, sf_dir):
    """M5 alone: threat vector and decision code per transaction."""
    return scored(spark, sf_dir).select("transaction_id", "vector", "status_code")


@register("risk_level")
def q_risk_level(spark, sf_dir):
    """M6 alone: risk score and level per transaction."""
    return scored(spark, sf_dir).select("transaction_id", "risk_score", "risk_level")


@register("kyc_verdict")
def q_kyc_verdict(spark, sf_dir):
    """P14 alone: REJECT when the decision text contains REJECT."""
    a = KY.kyc_assess(td.kyc_checks(spark, sf_dir))
    return a.select("document_uri", "decision", KY.kyc_verdict("decision").alias("kyc_verdict"))
