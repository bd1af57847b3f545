"""Adapters from the driver's star-schema tables to the fraud domain.

The driver ships TPC-H-like tables plus an ``events`` stream. Each function
here re-labels those columns into the domain tables of ``schemas.py`` as a
lazy projection, so Catalyst still prunes columns and pushes filters into
the parquet scans. Every mapping choice is listed in FIXTURES.md section 2
and mirrored by the SQL views in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import FraudGraph
from ..session import ensure_query_conf, materialize, spread

# Fixed values of the mapping (chosen by us, see FIXTURES.md section 2).
FRAUD_BALANCE = -900.0          # c_acctbal below this -> CONFIRMED_FRAUD
VICTIM_BALANCE = -800.0         # BUILDING segment below this -> VICTIM_COMPROMISED
VICTIM_SEGMENT = "BUILDING"
EMULATOR_NAME_PATTERN = "%ring%"
AUTH_EVENT_TYPES = {"signup": "PASSWORD_RESET", "error": "2FA_PHONE_CHANGED"}
KYC_ADDRESS_MODULUS = 100
BIN_BASE = 400_000
PROFILE_CUTOFF = "2024-01-15 00:00:00"  # spend profiles end here, later events are compared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, with the schema its files have now."""
    ensure_query_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prop_k() -> Column:
    """``k`` from the events ``props`` JSON text, e.g. '{"k": 69}'."""
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an append-only stream: the table's folder, restricted to
    the table's file, with the schema taken from the parquet footer."""
    schema = table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir.rstrip("/")))


def transactions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Card transactions from ``events``.

    transaction_id=event_id, account_id=user_id, amount=value,
    merchant_category=event_type, timestamp=ts; device and BIN come from
    ``k``; the masked PAN ends in the account number, so consecutive
    accounts on one BIN look like sequential card probing.
    """
    k = prop_k()
    ev = events if events is not None else table(spark, sf_dir, "events")
    bin6 = (k + BIN_BASE).cast("string")  # one BIN for each k
    last4 = F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0")
    return ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("account_id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("merchant_category"),
        k.alias("device_id"),
        F.concat(F.lit("198.51."), (k / 10).cast("int").cast("string"), F.lit("."),
                 (F.col("user_id") % 256).cast("string")).alias("ip_address"),
        F.col("ts").alias("timestamp"),
        F.when(k % 2 == 0, F.lit("IN_STORE_POS")).otherwise(F.lit("E_COMMERCE")).alias("channel"),
        ((k % 25) * 3.0 - 36.0).alias("latitude"),
        (F.floor(k / 4) * 12.0 - 150.0).alias("longitude"),
        bin6.alias("card_bin"),
        F.concat(bin6, F.lit("******"), last4).alias("card_pan_masked"),
        F.when(F.col("event_type") == "error", F.lit("DECLINED_CVV"))
         .otherwise(F.lit("APPROVED")).alias("auth_response_code"),
        k.alias("k"),
    )


def auth_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Authentication events: ``signup`` and ``error`` rows of ``events``."""
    k = prop_k()
    mapping = F.create_map(*[F.lit(x) for kv in AUTH_EVENT_TYPES.items() for x in kv])
    return ((events if events is not None else table(spark, sf_dir, "events"))
            .filter(F.col("event_type").isin(*AUTH_EVENT_TYPES))
            .select(F.col("event_id"), F.col("user_id").alias("account_id"),
                    k.alias("device_id"),
                    F.concat(F.lit("198.51."), (k / 10).cast("int").cast("string"), F.lit("."),
                             (F.col("user_id") % 256).cast("string")).alias("ip_address"),
                    mapping[F.col("event_type")].alias("event_type"),
                    F.col("ts").alias("timestamp")))


def historical_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive of past transactions: one per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("merchant_category"),
        F.col("o_orderdate").alias("timestamp"),
    )


def kyc_status() -> Column:
    return (F.when(F.col("c_acctbal") < FRAUD_BALANCE, F.lit("CONFIRMED_FRAUD"))
            .when((F.col("c_mktsegment") == VICTIM_SEGMENT) & (F.col("c_acctbal") < VICTIM_BALANCE),
                  F.lit("VICTIM_COMPROMISED"))
            .otherwise(F.lit("ACTIVE")))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to lineitem: the one big join every edge table needs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "inner")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct transfers of the order lines. A task sorts its lines for the
    join and holds them once more for the distinct, so both sides are spread."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = lines.count()  # of the file footers
    lines = spread(lines.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate"), n, "l_orderkey")
    orders = spread(orders, n, "o_orderkey")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .filter(F.col("o_custkey") != F.col("l_suppkey"))
            .select(F.col("l_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("src_account"),
                    F.col("l_suppkey").alias("dst_account"),
                    F.col("l_extendedprice").alias("amount"),
                    F.col("l_shipdate").alias("timestamp"))
            .distinct())


def graph(spark: SparkSession, sf_dir: str) -> FraudGraph:
    """The fraud property graph over the driver tables.

    Nodes: accounts=customer, devices=part, addresses=supplier.
    Edges: USED_DEVICE = distinct (o_custkey, l_partkey);
    SHIPPED_TO = distinct (o_custkey, l_suppkey);
    TRANSFERRED = distinct (order, o_custkey -> l_suppkey, price, shipdate).
    Edge tables are lazy plans. A pattern that reads them several times asks
    for ``written(...)``: both membership edge sets then come from one
    aggregation of the order lines, written once (partitioned by kind), so
    the orders x lineitem join runs once per query however many hops read
    the edges.
    """
    customer = table(spark, sf_dir, "customer")
    accounts = customer.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("customer_name"),
        kyc_status().alias("kyc_status"),
    )
    devices = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("device_id"),
        F.col("p_type").alias("device_type"),
        F.col("p_name").like(EMULATOR_NAME_PATTERN).alias("is_emulator"),
    )
    addresses = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("address_id"),
        F.col("s_name").alias("full_address"),
        (F.col("s_acctbal") < 0).alias("is_commercial_drop"),
    )
    lines = order_lines(spark, sf_dir)
    used_device = (lines.groupBy(F.col("o_custkey").alias("account_id"), F.col("l_partkey").alias("device_id"))
                   .agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen")))
    shipped_to = lines.select(F.col("o_custkey").alias("account_id"),
                              F.col("l_suppkey").alias("address_id")).distinct()

    def writer(names) -> dict[str, DataFrame]:
        """Both membership edge sets from one aggregation of the order lines,
        written once, partitioned by edge kind."""
        names = set(names)
        if not names <= {"used_device", "shipped_to"}:
            raise ValueError(f"cannot write {names}")
        if names != {"used_device", "shipped_to"}:
            (n,) = names
            return {n: materialize(used_device if n == "used_device" else shipped_to, f"edges-{n}")}
        both = (lines.select(
                    F.col("o_custkey").alias("account_id"),
                    F.explode(F.array(
                        F.struct(F.lit("D").alias("kind"), F.col("l_partkey").alias("node")),
                        F.struct(F.lit("A").alias("kind"), F.col("l_suppkey").alias("node")),
                    )).alias("e"),
                    F.col("l_shipdate").alias("ts"))
                .groupBy("account_id", F.col("e.kind").alias("kind"), F.col("e.node").alias("node"))
                .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))
        m = materialize(both, "membership-edges", partition_by=["kind"])
        return {
            "used_device": m.filter(F.col("kind") == "D").select(
                "account_id", F.col("node").alias("device_id"), "first_seen", "last_seen"),
            "shipped_to": m.filter(F.col("kind") == "A").select(
                "account_id", F.col("node").alias("address_id")),
        }

    return FraudGraph(accounts=accounts, devices=devices, addresses=addresses,
                      used_device=used_device, shipped_to=shipped_to, transferred=lambda: transfers(spark, sf_dir),
                      writer=writer)


def kyc_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document identity check results from ``labels``.

    toxic=1 -> the portrait (liveness) check failed; quality=0 -> the
    document shows tampering. The extracted address is supplier
    ``doc_id % 100``.
    """
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc://kyc/"), F.col("doc_id").cast("string")).alias("document_uri"),
        F.col("doc_id"),
        (F.col("toxic") != 1).alias("portrait_ok"),
        (F.col("quality") != 0).alias("document_ok"),
        (F.col("doc_id") % KYC_ADDRESS_MODULUS).alias("address_id"),
        F.col("doc_id").alias("account_id"),
        (1.0 - (F.col("doc_id") % 40).cast("double") / 100.0).alias("confidence_score"),
    )


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: uri, size in bytes and characters, source."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc://documents/"), F.col("doc_id").cast("string")).alias("document_uri"), "source",
        F.octet_length("text").cast("long").alias("size_bytes"), F.length("text").cast("long").alias("n_chars"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device nodes (part): emulator = name contains 'ring'."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("device_id"), F.col("p_type").alias("device_type"),
        F.col("p_name").like(EMULATOR_NAME_PATTERN).alias("is_emulator"))


def with_processed_at(txns: DataFrame) -> DataFrame:
    """Processing time of the stand-in stream: event time + k seconds."""
    return txns.withColumn("processed_at", F.expr("timestampadd(SECOND, k, timestamp)"))


# Fixed values of the reply mapping: next event type -> reply code.
REPLY_CODES = {"click": "1", "error": "2"}


def cardholder_replies(txns: DataFrame, holds: DataFrame) -> DataFrame:
    """Replies to holds: the account's next event after the held one;
    'click' answers 1 (legitimate), 'error' answers 2 (fraud), other types
    leave the hold unanswered. Next events come from the sliced lead, so a
    busy account is not one task."""
    from ..operators.sliced import epoch_us, sliced_next

    ev = txns.select("transaction_id", "account_id", "merchant_category",
                     "timestamp", epoch_us("timestamp").alias("__t"))
    nxt = sliced_next(ev, ["account_id"], "__t", "transaction_id",
                      ["merchant_category", "timestamp"])
    codes = F.create_map(*[F.lit(x) for kv in REPLY_CODES.items() for x in kv])
    rep = (nxt.join(holds.select(F.col("hold_id").alias("transaction_id")), "transaction_id", "left_semi")
           .select(F.col("transaction_id").alias("hold_id"),
                   codes[F.col("next_merchant_category")].alias("reply"),
                   F.col("next_timestamp").alias("replied_at")))
    return rep.filter(F.col("reply").isNotNull())


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocklist entries: device k is blocked when an 'error' event on it
    carries value > 200."""
    return (table(spark, sf_dir, "events")
            .filter((F.col("event_type") == "error") & (F.col("value") > 200))
            .select(prop_k().alias("device_id"), F.col("ts").alias("blocked_at")))


def scalar_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers and IPv4 addresses built from customer keys."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_acctbal", "c_mktsegment",
        F.concat(F.lit("4"), F.lpad(F.col("c_custkey").cast("string"), 15, "0")).alias("pan"),
        F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"),
                    (F.col("c_custkey") % 256).cast("string"),
                    (F.col("c_custkey") % 7).cast("string")).alias("ip_address"),
        ((F.col("c_custkey") % 1000) / F.lit(1000.0)).alias("ratio"))
