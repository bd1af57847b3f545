"""Exposure, evidence correlation, containment and operating measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,2)"


def money_sum(c: Column | str) -> Column:
    """Exact money total: each double amount is taken at cents first, so the
    result does not depend on the order the engine adds rows in."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(MONEY)).cast(MONEY_SUM)


def exposure(hist: DataFrame, target) -> DataFrame:
    """A1: COUNT(*) and SUM(amount) of one account's history (P4 filter).

    An account without history gives txns=0 and total_usd=NULL.
    """
    return (hist.filter(F.col("account_id") == F.lit(target))
            .agg(F.count(F.lit(1)).alias("txns"), money_sum("amount").alias("total_usd")))


def exposure_by_account(hist: DataFrame) -> DataFrame:
    """A2: exposure of every account; partial + final hash aggregate."""
    return hist.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("txns"), money_sum("amount").alias("total_usd"))


def investigate(ring: DataFrame, hist: DataFrame) -> DataFrame:
    """Agent investigation (G4 + A1 for many targets in one plan).

    ``ring`` is ``graph.linked_fraud`` output; each row gains the target's
    historical exposure. The exposure is aggregated per account before the
    join, so the join input is one row per account.
    """
    expo = exposure_by_account(hist).withColumnRenamed("account_id", "target")
    return (ring.join(expo, "target", "left")
            .select("target", "linked_fraud_user", "shared_device", "drop_address",
                    F.coalesce(F.col("txns"), F.lit(0).cast("long")).alias("txns"),
                    "total_usd"))


# Fixed value: the action the investigation dispatches for a linked target.
INVESTIGATION_ACTION = "TEMPORARY_CARD_FREEZE"


def investigation_actions(investigation: DataFrame, action: str = INVESTIGATION_ACTION) -> DataFrame:
    """Containment for investigated targets: one action row per target with at
    least one fraud link (rather than an unconditional dispatch), carrying
    the evidence counts and the exposure. Folded per target first."""
    return (investigation.groupBy("target")
            .agg(F.count(F.lit(1)).alias("n_links"),
                 F.countDistinct("linked_fraud_user").alias("n_linked_fraud_users"),
                 F.max("txns").alias("txns"), F.max("total_usd").alias("total_usd"))
            .withColumn("action", F.lit(action)))


# ------------------------------------------------------------ enrichment

def enrich(txns: DataFrame, accounts: DataFrame, devices: DataFrame) -> DataFrame:
    """Attach holder name / KYC status and device type to events.

    Plain left joins: the planner broadcasts a dimension only when its
    measured size is under the broadcast threshold (AQE re-plans at runtime),
    otherwise both sides shuffle on the key.
    """
    acc = accounts.select("account_id", "customer_name", "kyc_status")
    dev = devices.select("device_id", "device_type", "is_emulator")
    return txns.join(acc, "account_id", "left").join(dev, "device_id", "left")


# ------------------------------------------------------------ blocklists

def screen_blocklist(txns: DataFrame, blocks: DataFrame, key: str, ttl_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Active blocks on the row's key at the row's time.

    ``blocks(key, blocked_at)``; a block covers [blocked_at, blocked_at + ttl).
    Counted as a trailing range sum over block points, so a key blocked many
    times never pairs every block with every event. Adds ``n_active_blocks``
    and ``is_blocked`` (hits: ``filter(is_blocked)``; passes: the rest).
    """
    from .segments import largest, window_sums
    from .sliced import epoch_us

    d = txns.withColumn("__t", epoch_us("timestamp"))
    pts = blocks.select(F.col(key), epoch_us("blocked_at").alias("t"), F.lit(1).cast("long").alias("n_active_blocks"))
    out = window_sums(d, [key], "__t", {"n_active_blocks": F.lit(1).cast("long")}, lower=-ttl_us + 1, upper=0, points=pts,
                      most=largest(txns, [key]) + largest(blocks, [key]))
    out = out.withColumn("n_active_blocks", F.coalesce("n_active_blocks", F.lit(0).cast("long")))
    return out.withColumn("is_blocked", F.col("n_active_blocks") > 0).drop("__t")


def active_blocklist(blocks: DataFrame, key: str, as_of: Column, ttl_us: int = 24 * 3_600_000_000) -> DataFrame:
    """Keys whose latest block has not expired at ``as_of``."""
    ttl = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_us / 1_000_000))
    last = blocks.groupBy(key).agg(F.max("blocked_at").alias("last_blocked_at"))
    return (last.withColumn("expires_at", F.col("last_blocked_at") + ttl)
            .filter(F.col("expires_at") > as_of))


# ------------------------------------------------------------ containment

def containment_actions(scored: DataFrame, policy: DataFrame) -> DataFrame:
    """One action row per blocked transaction and action of its vector.

    ``policy(vector, actions)`` is a literal table of a handful of rows, so it
    is broadcast explicitly."""
    pol = F.broadcast(policy.select("vector", "actions"))
    return (scored.filter(F.col("verdict") == "BLOCKED")
            .join(pol, "vector", "inner")
            .select("transaction_id", "account_id", "vector",
                    F.posexplode("actions").alias("action_seq", "action")))


# Fixed value: the action that blocks a subnet for a day.
SUBNET_ACTION = "BLOCK_SUBNET_24H"


def subnet_blocks(actions: DataFrame, scored: DataFrame, txns: DataFrame) -> DataFrame:
    """R7 -> R8: (subnet, blocked_at) of the subnet actions; a block starts
    when the blocked transaction was processed."""
    from ..functions.scalars import ipv4_subnet

    hit = actions.filter(F.col("action") == SUBNET_ACTION).select("transaction_id")
    at = (scored.join(hit, "transaction_id", "left_semi").groupBy("transaction_id").agg(F.max("processed_at").alias("blocked_at")))
    subnet = txns.select("transaction_id", ipv4_subnet("ip_address").alias("subnet")).filter("subnet is not null").distinct()
    return at.join(subnet, "transaction_id").select("subnet", "blocked_at")


# Cardholder reply codes -> hold outcome.
REPLY_OUTCOME = {"1": "RELEASED", "2": "BLOCKED_PERMANENT"}


def resolve_holds(holds: DataFrame, replies: DataFrame) -> DataFrame:
    """Latest reply per hold decides: '1' releases, '2' makes the block
    permanent, no reply (or another code) leaves it PENDING.

    ``holds(hold_id, ...)``, ``replies(hold_id, reply, replied_at)``. The
    latest reply of a hold is taken before the join; of replies at one time
    the larger code counts, so a block wins over a release.
    """
    latest = replies.groupBy("hold_id").agg(F.max(F.struct("replied_at", "reply")).alias("last"))
    latest = latest.select("hold_id", "last.reply", "last.replied_at")
    m = F.create_map(*[F.lit(x) for kv in REPLY_OUTCOME.items() for x in kv])
    return (holds.join(latest, "hold_id", "left")
            .withColumn("status", F.coalesce(m[F.col("reply")], F.lit("PENDING"))))


def false_positive_rate(resolved: DataFrame) -> DataFrame:
    """Holds later confirmed legitimate / all holds (NULL when none)."""
    return resolved.agg(
        F.count(F.lit(1)).alias("n_blocked"),
        F.sum(F.when(F.col("status") == "RELEASED", 1).otherwise(0)).cast("long").alias("n_false_positive"),
    ).withColumn("false_positive_rate",
                 F.round(F.col("n_false_positive") / F.nullif(F.col("n_blocked"), F.lit(0)), 6))


def incident_exposure(resolved: DataFrame) -> DataFrame:
    """Per account, amount still pending; 0 once every hold is settled."""
    pending = F.col("status") == "PENDING"
    return resolved.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_holds"),
        F.sum(F.when(pending, 1).otherwise(0)).cast("long").alias("n_pending"),
        F.sum(F.when(F.col("status") == "BLOCKED_PERMANENT", 1).otherwise(0)).cast("long").alias("n_contained"),
        F.coalesce(money_sum(F.when(pending, F.col("amount"))), F.lit(0).cast(MONEY_SUM)).alias("pending_amount"),
    )


def prevented_by_day(scored: DataFrame) -> DataFrame:
    """Blocked count and blocked amount per processing day."""
    blocked = F.col("verdict") == "BLOCKED"
    return scored.groupBy(F.to_date("processed_at").alias("day")).agg(
        F.sum(F.when(blocked, 1).otherwise(0)).cast("long").alias("n_blocked"),
        F.coalesce(money_sum(F.when(blocked, F.col("amount"))), F.lit(0).cast(MONEY_SUM)).alias("prevented_total"),
    )


def _arrivals(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """(transaction_id, timestamp, processed_at), a row per id: both sides are folded before they meet."""
    first = raw.groupBy("transaction_id").agg(F.min("timestamp").alias("timestamp"))
    return first.join(scored.groupBy("transaction_id").agg(F.max("processed_at").alias("processed_at")), "transaction_id")


def decision_latency(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """A10: processed_at - timestamp per day of arrival: count, total and
    max in micros (exact). A repeated id is one transaction: it arrived with its
    first row and was processed with its last."""
    from .sliced import epoch_us

    j = _arrivals(raw, scored)
    lat = epoch_us("processed_at") - epoch_us("timestamp")
    return j.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(lat).alias("total_latency_us"),
        F.max(lat).alias("max_latency_us"),
    )


def decision_latency_percentiles(raw: DataFrame, scored: DataFrame, accuracy: int = 10000) -> DataFrame:
    """A10 per day of arrival: mean and p50, p95, p99 in seconds. Percentiles
    come from a bounded sketch: exact up to ``accuracy`` rows a day, beyond
    that with a rank error of at most 1 / ``accuracy``."""
    from .sliced import epoch_us

    j = _arrivals(raw, scored)
    us = epoch_us("processed_at") - epoch_us("timestamp")
    day = j.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.percentile_approx(us, [0.5, 0.95, 0.99], accuracy).alias("q"),
        F.count(F.lit(1)).alias("n"), F.sum(us).alias("total"))
    seconds = [F.round(F.get("q", i) / F.lit(1e6), 6).alias(f"p{x}_s") for i, x in enumerate((50, 95, 99))]
    return day.select("day", F.round(F.col("total") / F.col("n") / F.lit(1e6), 6).alias("mean_s"), *seconds)


# ------------------------------------------------------------ dossier

def triage_dossier(scored: DataFrame, ring_pairs: DataFrame, hist: DataFrame, kyc: DataFrame) -> DataFrame:
    """Per account, alerts x graph links x KYC x historical exposure, with
    the evidence as (heading, detail) pairs.

    Each source is folded to one row per account first (alerts: blocked count
    and amount, and which headings fired; ring: matches and distinct linked
    fraudsters; ``kyc(account_id, kyc_verdict)``: documents and rejections),
    so the joins are one-to-one on account_id. Accounts with any alert or
    ring link are kept. A link to confirmed fraudsters and rejected documents
    are evidence items too.
    """
    from .scoring import EVIDENCE

    blocked = F.col("verdict") == "BLOCKED"
    alerts = scored.groupBy("account_id").agg(
        F.sum(F.when(blocked, 1).otherwise(0)).cast("long").alias("n_alerts"),
        F.coalesce(money_sum(F.when(blocked, F.col("amount"))), F.lit(0).cast(MONEY_SUM)).alias("blocked_total"),
        *[F.max(F.col(c)).alias(f"__{c}") for c in EVIDENCE])
    ring = ring_pairs.groupBy(F.col("suspicious_id").alias("account_id")).agg(
        F.count(F.lit(1)).alias("n_ring_matches"),
        F.countDistinct("fraud_id").alias("n_linked_fraud"))
    documents = kyc.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.when(F.col("kyc_verdict") == "REJECT", 1).otherwise(0)).cast("long").alias("n_rejected"))
    zero = F.lit(0).cast("long")
    d = alerts.join(ring, "account_id", "full_outer")
    d = d.filter((F.col("n_alerts") > 0) | (F.col("n_ring_matches") > 0))
    d = d.join(documents, "account_id", "left").join(exposure_by_account(hist), "account_id", "left")

    def item(fired, heading, detail):
        return F.when(F.coalesce(fired, F.lit(False)), F.struct(F.lit(heading).alias("heading"), detail.alias("detail")))

    items = [item(F.col(f"__{c}"), h, F.lit(x)) for c, (h, x) in EVIDENCE.items()]
    items.append(item(F.col("n_linked_fraud") > 0, "Syndicate Graph Link",
                      F.concat(F.lit("Shares a device and an address with confirmed fraud accounts: "), F.col("n_linked_fraud").cast("string"))))
    items.append(item(F.col("n_rejected") > 0, "Identity Documents Rejected",
                      F.concat(F.col("n_rejected").cast("string"), F.lit(" of "), F.col("n_documents").cast("string"))))
    return d.select(
        "account_id", F.coalesce("n_alerts", zero).alias("n_alerts"),
        F.coalesce("blocked_total", F.lit(0).cast(MONEY_SUM)).alias("blocked_total"),
        F.coalesce("n_ring_matches", zero).alias("n_ring_matches"), F.coalesce("n_linked_fraud", zero).alias("n_linked_fraud"),
        F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("n_rejected", zero).alias("n_rejected"),
        F.coalesce("txns", zero).alias("txns"), "total_usd",
        F.filter(F.array(*items), lambda x: x.isNotNull()).alias("evidence"))
