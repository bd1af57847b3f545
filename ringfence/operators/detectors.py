"""Fraud detectors over transaction / auth event tables.

Row-level trailing detectors use the ordered scans of ``segments.py`` so a
hot account, device or BIN, even within one second, is split over ranges
instead of landing in one task. A repeated or null transaction id is a row like
any other: every row counts, and results come with the row. Tumbling-window counts are plain grouped aggregates (map-side
partial aggregation; distinct counts shuffle on (group, value) first).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as SC
from .segments import largest, previous, window_distinct, window_sums
from .sliced import DAY_US, HOUR_US, epoch_us
from .triage import MONEY, MONEY_SUM

SECOND_US = 1_000_000


def _with_t(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("__t", epoch_us(ts))


def spend_baseline(txns: DataFrame, days: int = 90) -> DataFrame:
    """Each transaction with its account's spend over the previous ``days``
    days, current row and same-instant rows excluded: ``baseline_n`` rows
    totalling ``baseline_total`` (exact cents)."""
    d = _with_t(txns)
    out = window_sums(d, ["account_id"], "__t",
                      {"baseline_n": F.lit(1).cast("long"),
                       "baseline_total": F.col("amount").cast(MONEY)},
                      lower=-days * DAY_US, upper=-1)
    return out.withColumn("baseline_n", F.coalesce("baseline_n", F.lit(0).cast("long"))).drop("__t")


def is_spike(factor: float) -> Column:
    """W1's condition on ``amount``, ``baseline_n`` and ``baseline_total``."""
    amt = F.col("amount").cast(MONEY)
    return (F.col("baseline_n") > 0) & (amt * F.col("baseline_n") >= F.lit(Decimal(str(factor))) * F.col("baseline_total"))


def spend_spike(txns: DataFrame, days: int = 90, factor: float = 30.0) -> DataFrame:
    """Amount >= factor x the mean of the previous ``days`` days.

    Compared exactly as amount * n >= factor * total, so no rounded mean
    decides the flag. Accounts without history are not flagged.
    """
    b = spend_baseline(txns.select("transaction_id", "account_id", "amount", "timestamp"), days)
    return b.filter(is_spike(factor)).select(
        "transaction_id", "account_id", "amount", "baseline_n",
        F.col("baseline_total").cast(MONEY_SUM).alias("baseline_total"))


def travel(prev_t: str, prev_latitude: str, prev_longitude: str, max_kmh: float, min_jump_km: float = 100.0) -> tuple[Column, ...]:
    """W2's distance, elapsed seconds, speed and flag of a located swipe and the one before."""
    dist = SC.haversine_km(prev_latitude, prev_longitude, "latitude", "longitude")
    elapsed_s = (F.col("__t") - F.col(prev_t)) / F.lit(float(SECOND_US))
    speed = F.when(F.col(prev_t).isNull(), F.lit(0.0)) \
             .when(elapsed_s > 0, dist / (elapsed_s / F.lit(3600.0)))
    flag = F.when(F.col(prev_t).isNull(), F.lit(False)) \
            .when(elapsed_s > 0, speed > F.lit(max_kmh)) \
            .otherwise(dist > F.lit(min_jump_km))
    return dist, elapsed_s, speed, flag


def geo_velocity(txns: DataFrame, max_kmh: float = 900.0, min_jump_km: float = 100.0,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Speed from the previous located swipe of the same account.

    Only rows with coordinates take part. First swipe: speed 0.0. Zero
    elapsed time: speed NULL, flagged when the jump exceeds ``min_jump_km``.
    Distances and speeds are rounded to 3 decimals.
    """
    d = _with_t(txns.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()))
    d = d.select("transaction_id", "account_id", "latitude", "longitude", "__t", *keep)
    p = previous(d, ["account_id"], "__t", ["transaction_id", "latitude", "longitude"], ["__t", "transaction_id", "latitude", "longitude"])
    dist, elapsed_s, speed, flag = travel("prev___t", "prev_latitude", "prev_longitude", max_kmh, min_jump_km)
    return p.select(
        "transaction_id", "account_id",
        F.col("prev_transaction_id").alias("prev_transaction_id"),
        F.round(dist, 3).alias("distance_km"),
        elapsed_s.alias("elapsed_s"),
        F.round(speed, 3).alias("calculated_speed_kmh"),
        flag.alias("is_impossible_travel"), *keep)


def episode_rows(rows: DataFrame, flagged: DataFrame, keys: list[str], window_us: int, most: int) -> DataFrame:
    """Rows that belong to a flagged row's trailing window.

    A row at t is in the episode of a flagged row at t' when t <= t' <= t + w
    (same keys): a forward range count over the flagged rows as points, so no
    row is paired with every flagged row. ``rows`` and ``flagged`` carry
    (keys, __t), ``most`` rows of a key at most."""
    pts = flagged.select(*keys, F.col("__t").alias("t"), F.lit(1).cast("long").alias("n_flagged"))
    out = window_sums(rows, keys, "__t", {"n_flagged": F.lit(1).cast("long")}, lower=0, upper=window_us, points=pts, most=2 * most)
    return out.filter(F.col("n_flagged") > 0).drop("n_flagged")


def bin_velocity_rows(txns: DataFrame, window_us: int = 24 * HOUR_US, max_amount: float = 2.0,
                      min_count: int = 3, episode: bool = False) -> DataFrame:
    """Micro-amount attempts on the row's BIN within [t - window, t];
    rows reaching ``min_count`` are returned with the count. With
    ``episode`` every micro row inside a triggering window is returned
    (the earlier attempts of a burst too), without the count."""
    d = _with_t(txns.filter(F.col("amount") <= F.lit(max_amount)))
    d = d.select("transaction_id", "card_bin", "__t")
    most = largest(d, ["card_bin"])
    out = window_sums(d, ["card_bin"], "__t", {"n_attempts": F.lit(1).cast("long")}, lower=-window_us, upper=0, most=most)
    flagged = out.filter(F.col("n_attempts") >= min_count)
    if episode:
        return episode_rows(d, flagged, ["card_bin"], window_us, most).select(
            "transaction_id", "card_bin")
    return flagged.select("transaction_id", "card_bin", "n_attempts")


def ato_fan_in_rows(auth: DataFrame, window_us: int = 12 * HOUR_US, min_accounts: int = 3,
                    episode: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct accounts that hit the row's device within [t - window, t];
    rows reaching ``min_accounts`` are returned. With ``episode`` every event
    inside a triggering window is returned (all accounts of the fan-in)."""
    d = _with_t(auth).select("event_id", "device_id", "account_id", "__t")
    most = largest(d, ["device_id"])
    out = window_distinct(d, ["device_id"], "account_id", "__t", window_us, out="n_accounts", most=most)
    flagged = out.filter(F.col("n_accounts") >= min_accounts)
    if episode:
        return episode_rows(d, flagged, ["device_id"], window_us, most).select(
            "event_id", "device_id", "account_id", *keep)
    return flagged.select("event_id", "device_id", "account_id", "n_accounts", *keep)


def dormant_bust_out(txns: DataFrame, gap_us: int = 2 * DAY_US, min_amount: float = 50.0) -> DataFrame:
    """A transaction over ``min_amount`` after more than ``gap_us`` without
    activity on the account (the first transaction has no gap)."""
    d = _with_t(txns).select("transaction_id", "account_id", "amount", "__t")
    p = previous(d, ["account_id"], "__t", ["transaction_id", "amount"], ["__t"])
    gap = F.col("__t") - F.col("prev___t")
    return p.filter((gap > F.lit(gap_us)) & (F.col("amount") > F.lit(min_amount))).select(
        "transaction_id", "account_id", "amount",
        F.round(gap / F.lit(float(DAY_US)), 6).alias("idle_days"))


def sequential_pan(txns: DataFrame) -> DataFrame:
    """Card probing -- on one (BIN, device) the masked PAN's last four
    digits rise by exactly one from the previous attempt."""
    d = _with_t(txns).select(
        "transaction_id", "card_bin", "device_id", "card_pan_masked", "__t",
        F.substring("card_pan_masked", -4, 4).cast("int").alias("pan_last4"))
    p = previous(d, ["card_bin", "device_id"], "__t", ["transaction_id", "card_pan_masked"], ["transaction_id", "pan_last4"])
    return p.filter(F.col("pan_last4") - F.col("prev_pan_last4") == 1).select(
        "transaction_id", "card_bin", "device_id", "card_pan_masked", "prev_transaction_id")


def tumbling(ts: Column | str, size: str) -> Column:
    """Start of the tumbling window of ``size`` containing ``ts``."""
    return F.window(ts, size).start


def ato_fan_in(auth: DataFrame, window: str = "1 day", min_accounts: int = 3) -> DataFrame:
    """A4: per device and tumbling window, distinct accounts, events, first
    and last time; devices reaching ``min_accounts`` are returned."""
    return (auth.groupBy(tumbling("timestamp", window).alias("window_start"), "device_id")
            .agg(F.countDistinct("account_id").alias("n_accounts"),
                 F.count(F.lit(1)).alias("n_events"),
                 F.min("timestamp").alias("first_seen"),
                 F.max("timestamp").alias("last_seen"))
            .filter(F.col("n_accounts") >= min_accounts))


def bin_velocity(txns: DataFrame, window: str = "1 day", max_amount: float = 2.0,
                 min_count: int = 3) -> DataFrame:
    """A5: micro-amount authorisations per BIN and tumbling window."""
    return (txns.filter(F.col("amount") <= F.lit(max_amount))
            .groupBy(tumbling("timestamp", window).alias("window_start"), "card_bin")
            .agg(F.count(F.lit(1)).alias("n_attempts"),
                 F.countDistinct("card_pan_masked").alias("n_cards"))
            .filter(F.col("n_attempts") >= min_count))


def subnet_spread(txns: DataFrame, window: str = "1 day") -> DataFrame:
    """Distinct cards and declines per /24 subnet and tumbling window."""
    declined = F.col("auth_response_code").startswith("DECLINED")
    return (txns.groupBy(tumbling("timestamp", window).alias("window_start"),
                         SC.ipv4_subnet("ip_address").alias("subnet"))
            .agg(F.countDistinct("card_pan_masked").alias("n_cards"),
                 F.sum(F.when(declined, 1).otherwise(0)).cast("long").alias("n_declines"),
                 F.count(F.lit(1)).alias("n_attempts")))


AMOUNT_BITS = 62  # order-preserving code of cents: a decimal(18,2) has under 2**60 of them


def _amount_code(amount: Column) -> Column:
    """Cents shifted to a non-negative long, so bit order = amount order."""
    cents = (amount.cast(MONEY) * 100).cast("long")
    return cents + F.lit(1 << (AMOUNT_BITS - 1))


def smurfing(transfers: DataFrame, window_us: int = 30 * DAY_US, min_splits: int = 3,
             max_pairs_per_group: int = 2_000_000) -> DataFrame:
    """An inflow to an account followed, within ``window_us``, by at least
    ``min_splits`` smaller outflows from that account. Amounts are compared
    and added in whole cents everywhere.

    Transfers are compared as distinct rows. Columns: the inflow's columns
    plus n_splits and split_total.

    Two exact paths, chosen per (account, time bucket) group by a measured
    candidate count (a grouped count, combined map-side):

    * ordinary groups: interval join bucketed by time -- each inflow meets the
      outflows of its account in its own bucket and the next (bucket width =
      window); range and amount conditions filter; per-inflow counts
      aggregate in the join's stage.
      The result is the same on either path; the switch bounds the work.
    * hot groups (more than ``max_pairs_per_group`` candidate pairs): no pairs
      at all. "Smaller amount" is a dominance test, decomposed by bits: for
      amount codes r_o < r_i there is exactly one bit level where they first
      differ, with r_o's bit 0 and r_i's bit 1. Each outflow becomes one
      point per level with bit 0, keyed (account, level, higher bits); each
      inflow one query per level with bit 1; the time condition is then a
      sliced range sum. Replication is bounded by the bit count, not by the
      group size.
    """
    from ..session import materialize
    from .sliced import range_sums

    cols = ("order_id", "src_account", "dst_account", "amount", "timestamp")
    # The distinct transfers feed every branch below: written once.
    tx = materialize(
        transfers.select(*cols).distinct()
        .withColumn("__t", epoch_us("timestamp"))
        .withColumn("__b", F.floor(F.col("__t") / F.lit(window_us)).cast("long")),
        "smurfing-transfers")
    keys = [f"in_{c}" for c in cols]
    inflow = tx.select(*[F.col(c).alias(f"in_{c}") for c in cols],
                       F.col("__t").alias("in_t"), F.col("__b").alias("in_b"))
    outflow = tx.select(F.col("src_account").alias("out_account"), F.col("amount").cast(MONEY).alias("out_amount"),
                        F.col("__t").alias("out_t"), F.col("__b").alias("bucket"))

    # Candidate pairs per inflow group (account, bucket): inflows x outflows
    # of the same account in buckets b and b + 1 (grouped counts only).
    n_in = tx.groupBy(F.col("dst_account").alias("acct"), F.col("__b").alias("b")).agg(
        F.count(F.lit(1)).alias("n_in"))
    n_out = (tx.groupBy(F.col("src_account").alias("acct"), F.col("__b").alias("ob"))
             .agg(F.count(F.lit(1)).alias("n_out"))
             .select("acct", F.explode(F.array(F.col("ob"), F.col("ob") - 1)).alias("b"), "n_out")
             .groupBy("acct", "b").agg(F.sum("n_out").alias("n_reach")))
    groups = n_in.join(n_out, ["acct", "b"], "inner").withColumn("pairs", F.col("n_in") * F.col("n_reach"))
    # One number decides whether the dominance path is planned at all.
    worst = groups.agg(F.max("pairs")).first()[0] or 0
    if worst > max_pairs_per_group:
        hot = materialize(groups.filter(F.col("pairs") > F.lit(max_pairs_per_group)).select(
            F.col("acct").alias("in_dst_account"), F.col("b").alias("in_b")), "smurfing-hot-groups")
        cold_in = inflow.join(hot, ["in_dst_account", "in_b"], "left_anti")
        hot_in = inflow.join(hot, ["in_dst_account", "in_b"], "left_semi")
    else:
        hot, cold_in, hot_in = None, inflow, None

    # Ordinary groups: bucketed interval join.
    ci = cold_in.select(*keys, "in_t", F.explode(F.array(F.col("in_b"), F.col("in_b") + 1)).alias("bucket"))
    cond = ((ci.in_dst_account == outflow.out_account) & (ci.bucket == outflow.bucket)
            & (outflow.out_t >= ci.in_t) & (outflow.out_t <= ci.in_t + F.lit(window_us))
            & (outflow.out_amount < ci.in_amount.cast(MONEY)))
    cold = (ci.join(outflow, cond, "inner").groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_splits"),
                 F.sum("out_amount").cast(MONEY_SUM).alias("split_total")))

    if hot is None:
        agg = cold.filter(F.col("n_splits") >= min_splits)
        return agg.select(*[F.col(k).alias(k[3:]) for k in keys], "n_splits", "split_total")

    # Hot groups: bit-level dominance points + sliced time-range sums.
    levels = F.sequence(F.lit(0), F.lit(AMOUNT_BITS - 1))
    hot_accounts = hot.select(F.col("in_dst_account").alias("out_account")).distinct()
    pts = (outflow.join(hot_accounts, "out_account", "left_semi")
           .select("out_account", "out_t", _amount_code(F.col("out_amount")).alias("code"),
                   (F.col("out_amount").cast(MONEY) * 100).cast("long").alias("cents"),
                   F.explode(levels).alias("lvl"))
           .filter(F.expr("(code >> lvl) & 1") == 0)
           .select(F.col("out_account").alias("acct"), "lvl", F.expr("code >> (lvl + 1)").alias("hi"),
                   F.col("out_t").alias("t"), F.lit(1).cast("long").alias("n"), "cents"))
    qs = (hot_in.select(*keys, "in_t", _amount_code(F.col("in_amount")).alias("code"),
                        F.explode(levels).alias("lvl"))
          .filter(F.expr("(code >> lvl) & 1") == 1)
          .select(*keys, F.col("in_dst_account").alias("acct"), "lvl",
                  F.expr("code >> (lvl + 1)").alias("hi"), "in_t",
                  F.struct(*keys, "lvl").alias("qid")))
    sums = range_sums(qs, ["acct", "lvl", "hi"], "in_t", "qid",
                      {"n": F.lit(1).cast("long"), "cents": F.lit(0).cast("long")},
                      lower=0, upper=window_us, width=max(window_us // 4, 1), points=pts)
    hot_res = (sums.groupBy(*keys)
               .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_splits"),
                    (F.sum(F.coalesce("cents", F.lit(0))).cast("decimal(38,0)") / 100)
                    .cast(MONEY_SUM).alias("split_total")))

    agg = cold.unionByName(hot_res).filter(F.col("n_splits") >= min_splits)
    return agg.select(*[F.col(k).alias(k[3:]) for k in keys], "n_splits", "split_total")
