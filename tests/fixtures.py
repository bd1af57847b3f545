"""Literal rows of the reference (FIXTURES.md section 1) as DataFrames."""

from __future__ import annotations

import datetime as dt

from ringfence import schemas
from ringfence.operators.graph import FraudGraph

T0 = dt.datetime(2026, 1, 15, 12, 0, 0)


def hist(spark):
    rows = [
        ("hist_001", "acc_syndicate_01", 120.50, "groceries", "dev_fp_ring_99", "2024-01-15 10:20:00"),
        ("hist_002", "acc_syndicate_01", 450.00, "electronics", "dev_fp_ring_99", "2024-03-22 14:10:00"),
        ("hist_003", "acc_syndicate_02", 980.00, "luxury_retail", "dev_fp_ring_99", "2024-06-11 18:30:00"),
        ("hist_004", "acc_legit_100", 35.00, "gas_station", "dev_fp_clean_01", "2025-02-01 08:45:00"),
        ("hist_005", "acc_syndicate_03", 2200.00, "crypto_exchange", "dev_fp_ring_99", "2025-07-19 22:15:00"),
    ]
    return spark.createDataFrame(rows, schemas.HISTORICAL_TRANSACTIONS)


def live(spark, geo_gap_minutes: int = 15):
    m = dt.timedelta(minutes=1)
    rows = [
        # id, account, amount, category, device, ip, ship, ts, channel, lat, lon, bin, pan, code
        ("txn_clean_1", "acc_legit_100", 42.50, "coffee_shop", "dev_fp_clean_01", None, None, T0,
         "IN_STORE_POS", 37.7749, -122.4194, None, None, None),
        ("txn_clean_2", "acc_legit_101", 89.20, "grocery_retail", "dev_fp_clean_02", None, None, T0 + m,
         "IN_STORE_POS", 37.7833, -122.4167, None, None, None),
        ("txn_fraud_1", "acc_syndicate_02", 1950.00, "electronics_online", "dev_fp_ring_99", None, None,
         T0 + 2 * m, "E_COMMERCE", None, None, None, None, None),
        ("txn_fraud_2", "acc_syndicate_03", 2400.00, "crypto_exchange", "dev_fp_ring_99", None, None,
         T0 + 3 * m, "E_COMMERCE", None, None, None, None, None),
        ("txn_bin_1", "acc_botnet_01", 0.99, "charity_donation", "dev_fp_bot_01", None, None, T0 + 4 * m,
         "E_COMMERCE", None, None, "411111", "411111******1029", "DECLINED_CVV"),
        ("txn_bin_2", "acc_botnet_01", 1.25, "digital_gaming", "dev_fp_bot_01", None, None,
         T0 + 4 * m + dt.timedelta(seconds=1), "E_COMMERCE", None, None, "411111", "411111******1030",
         "DECLINED_CVV"),
        ("txn_geo_ny", "acc_legit_100", 120.00, "luxury_retail", "pos_ny_01", None, None, T0 + 10 * m,
         "IN_STORE_POS", 40.7128, -74.0060, None, None, None),
        ("txn_geo_lon", "acc_legit_100", 850.00, "jewelry_store", "pos_london_02", None, None,
         T0 + (10 + geo_gap_minutes) * m, "IN_STORE_POS", 51.5074, -0.1278, None, None, None),
        ("txn_live_901", "acc_syndicate_02", 1850.00, "electronics_online", "dev_fp_ring_99",
         "198.51.100.24", "104 Industrial Pkwy Ste B", T0 + 40 * m, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, schemas.LIVE_TRANSACTIONS)


def scored(spark):
    rows = [
        ("txn_clean_1", False, False, False, False),
        ("txn_clean_2", False, False, False, False),
        ("txn_fraud_1", True, True, False, False),
        ("txn_fraud_2", True, True, False, False),
        ("txn_bin_1", True, False, True, False),
        ("txn_bin_2", True, False, True, False),
        ("txn_geo_ny", False, False, False, False),
        ("txn_geo_lon", True, True, False, True),
    ]
    return spark.createDataFrame(
        rows, "transaction_id string, is_suspicious_device boolean, is_high_risk_amount boolean, "
              "is_bin_attack boolean, is_impossible_travel boolean")


def auth(spark):
    s = dt.timedelta(seconds=60)
    rows = [
        ("auth_1", "acc_legit_100", "dev_fp_ring_99", "198.51.100.24", "PASSWORD_RESET", T0),
        ("auth_2", "acc_legit_101", "dev_fp_ring_99", "198.51.100.24", "2FA_PHONE_CHANGED", T0 + s),
        ("auth_3", "acc_legit_102", "dev_fp_ring_99", "198.51.100.24", "PASSWORD_RESET", T0 + 2 * s),
    ]
    return spark.createDataFrame(rows, schemas.AUTH_EVENTS)


def graph(spark) -> FraudGraph:
    accounts = spark.createDataFrame([
        ("acc_syndicate_01", "Alex Mercer", "CONFIRMED_FRAUD"),
        ("acc_syndicate_02", "Jordan Vance", "ACTIVE"),
        ("acc_syndicate_03", "Taylor Reed", "ACTIVE"),
        ("acc_victim_01", "Pat Doe", "VICTIM_COMPROMISED"),
        ("acc_mule_01", "Tier One", "ACTIVE"),
        ("acc_mule_02", "Tier Two", "ACTIVE"),
        ("acc_offramp", "Crypto Off-Ramp", "ACTIVE"),
    ], schemas.ACCOUNTS)
    devices = spark.createDataFrame([("dev_fp_ring_99", "emulator", True)], schemas.DEVICES)
    addresses = spark.createDataFrame([("addr_104", "104 Industrial Pkwy", True)], schemas.ADDRESSES)
    used = spark.createDataFrame([
        (a, "dev_fp_ring_99", "PASSWORD_RESET", T0)
        for a in ("acc_syndicate_01", "acc_syndicate_02", "acc_syndicate_03")], schemas.USED_DEVICE)
    shipped = spark.createDataFrame([
        (a, "addr_104") for a in ("acc_syndicate_01", "acc_syndicate_02", "acc_syndicate_03")],
        schemas.SHIPPED_TO)
    h = dt.timedelta(hours=1)
    transfers = spark.createDataFrame(
        [("t0", "acc_victim_01", "acc_mule_01", 10000.0, T0)]
        + [(f"t{i}", "acc_mule_01", "acc_mule_02", 2450.0, T0 + i * h) for i in range(1, 5)]
        + [("t9", "acc_mule_02", "acc_offramp", 9800.0, T0 + 6 * h)],
        schemas.TRANSFERS)
    return FraudGraph(accounts, devices, addresses, used, shipped,
                      transfers.withColumnRenamed("transfer_id", "order_id"))


def kyc(spark):
    rows = [
        ("doc://kyc/marcus.png", "MARCUS VANCE", "104 Industrial Pkwy Ste B, Wilmington DE", False, False, 0.992),
        ("doc://kyc/jordan.png", "JORDAN VANCE", "104 Industrial Pkwy Ste B, Wilmington DE", True, False, 0.984),
        ("doc://kyc/sarah.png", "SARAH JENKINS", "742 Evergreen Terr, Sunnyvale CA", True, True, 0.997),
    ]
    return spark.createDataFrame(
        rows, "document_uri string, applicant_name string, extracted_address string, "
              "portrait_ok boolean, document_ok boolean, confidence_score double")
