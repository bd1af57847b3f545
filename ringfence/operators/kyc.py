"""Identity-document checks.

Input is a table of per-document check results; image inspection itself is
outside this library. The graph link pre-aggregates the fraud side per
address before it meets the documents, so a drop address shared by many
accounts costs one summary row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as SC
from .graph import CONFIRMED_FRAUD, FraudGraph

# Decisions and link texts as the reference writes them.
REJECT_PORTRAIT = "REJECT_DEEPFAKE_PORTRAIT"
REJECT_FORGED = "REJECT_FORGED_ID"
APPROVE = "APPROVE"
REJECT_CODES = {"portrait": REJECT_PORTRAIT, "document": REJECT_FORGED}
NO_LINK = "No adverse graph links."
LINK_PREFIX = "Direct Link to "


def kyc_decision(portrait_ok: Column, document_ok: Column) -> Column:
    """Portrait failure first, then tampering, else approve.
    A missing check result counts as failed."""
    return (F.when(~F.coalesce(portrait_ok, F.lit(False)), F.lit(REJECT_PORTRAIT))
            .when(~F.coalesce(document_ok, F.lit(False)), F.lit(REJECT_FORGED))
            .otherwise(F.lit(APPROVE)))


def kyc_verdict(decision: Column | str) -> Column:
    """REJECT when the decision text contains 'REJECT'."""
    d = F.col(decision) if isinstance(decision, str) else decision
    return F.when(d.contains("REJECT"), F.lit("REJECT")).otherwise(F.lit("APPROVE"))


def kyc_assess(checks: DataFrame, check_cols: dict[str, str] | None = None) -> DataFrame:
    """M4: check matrix -> tampered flag, failed-check list, decision.

    ``check_cols`` maps a check name to its boolean column (True = passed; a
    missing result counts as failed). The first failed check, in the map's
    order, decides: ``REJECT_CODES`` has its decision, other checks reject
    under their own name. A document is tampered when any check but the
    portrait fails.
    """
    check_cols = check_cols or {"portrait": "portrait_ok", "document": "document_ok"}
    bad = {name: ~F.coalesce(F.col(c), F.lit(False)) for name, c in check_cols.items()}
    tampered = reduce(lambda a, b: a | b, [v for k, v in bad.items() if k != "portrait"], F.lit(False))
    failed = F.filter(F.array(*[F.when(v, F.lit(name)) for name, v in bad.items()]), lambda x: x.isNotNull())
    decision = F.coalesce(*[F.when(v, F.lit(REJECT_CODES.get(name, f"REJECT_{name.upper()}"))) for name, v in bad.items()],
                          F.lit(APPROVE))
    return checks.select(
        "*",
        tampered.alias("is_tampered"),
        F.array_join(failed, ",").alias("failed_checks"),
        decision.alias("decision"),
        kyc_verdict(decision).alias("kyc_verdict"))


def fraud_by_address(g: FraudGraph) -> DataFrame:
    """Per normalised address: confirmed-fraud accounts shipping there."""
    fraud = g.accounts.filter(F.col("kyc_status") == CONFIRMED_FRAUD).select(
        "account_id", F.col("customer_name").alias("fraud_name"))
    addr = g.addresses.select("address_id", SC.normalize_address("full_address").alias("address_key"))
    # distinct accounts of a key: one account at two nodes of it counts once
    return (g.shipped_to.select("account_id", "address_id")
            .join(fraud, "account_id", "inner").join(addr, "address_id", "inner")
            .groupBy("address_key")
            .agg(F.countDistinct("account_id").alias("n_linked_fraud"),
                 F.min("fraud_name").alias("fraud_name")))


def kyc_graph_link(docs: DataFrame, g: FraudGraph, address_col: str = "extracted_address") -> DataFrame:
    """Extracted address -> address node -> confirmed fraud shippers.

    Adds ``n_linked_fraud`` and ``graph_syndicate_link`` text (or the
    no-link text)."""
    summ = fraud_by_address(g)
    d = docs.withColumn("address_key", SC.normalize_address(address_col))
    d = d.join(summ, "address_key", "left").drop("address_key")
    n = F.coalesce(F.col("n_linked_fraud"), F.lit(0).cast("long"))
    link = F.when(n > 0, F.concat(F.lit(LINK_PREFIX), F.col("fraud_name"), F.lit(" via "),
                                   F.col(address_col))).otherwise(F.lit(NO_LINK))
    return d.withColumn("n_linked_fraud", n).withColumn("graph_syndicate_link", link).drop("fraud_name")


def kyc_summary(audit: DataFrame) -> DataFrame:
    """Documents, tampered documents and mean confidence per decision."""
    return audit.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.when(F.col("is_tampered"), 1).otherwise(0)).cast("long").alias("n_tampered"),
        F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))
