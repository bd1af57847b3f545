"""Feed projections, latest-N views and the unified event feed
(P1-P3, T1-T3, U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as SC


def raw_feed(df: DataFrame) -> DataFrame:
    """Raw stream columns with NULL defaults (BIN 'N/A', channel 'POS')."""
    return df.select("transaction_id", "account_id", "amount", "merchant_category",
                     F.coalesce(F.col("card_bin").cast("string"), F.lit("N/A")).alias("bin"),
                     F.coalesce(F.col("channel"), F.lit("POS")).alias("channel"))


def scored_feed(df: DataFrame) -> DataFrame:
    """Id, account, amount and the four stored flags."""
    return df.select("transaction_id", "account_id", "amount", "is_bin_attack",
                     "is_impossible_travel", "is_suspicious_device", "is_high_risk_amount")


def kyc_feed(df: DataFrame) -> DataFrame:
    """Audit columns shown in the KYC trail."""
    return df.select("applicant_name", "extracted_address", "is_tampered", "confidence_score",
                     "decision", "graph_syndicate_link")


def latest(df: DataFrame, ts: str, n: int = 5, tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows by ``ts`` (ties broken by ``tie`` descending).
    Planned as TakeOrderedAndProject: each task keeps its own top n."""
    order = [F.col(ts).desc_nulls_last()]
    if tie:
        order.append(F.col(tie).desc_nulls_last())
    return df.orderBy(*order).limit(n)


def unified_feed(txns: DataFrame, auth: DataFrame) -> DataFrame:
    """Auth events join the transaction feed as amount 0, BIN 'N/A',
    channel 'MOBILE_AUTH', category from F15 (bag union)."""
    card = txns.select("transaction_id", "account_id", "amount", "merchant_category",
                       F.coalesce(F.col("card_bin").cast("string"), F.lit("N/A")).alias("bin"),
                       F.coalesce(F.col("channel"), F.lit("POS")).alias("channel"), "timestamp")
    au = auth.select(F.col("event_id").alias("transaction_id"), "account_id",
                     F.lit(0.0).alias("amount"),
                     SC.auth_category("event_type").alias("merchant_category"),
                     F.lit("N/A").alias("bin"), F.lit("MOBILE_AUTH").alias("channel"), "timestamp")
    return card.unionByName(au, allowMissingColumns=True)
