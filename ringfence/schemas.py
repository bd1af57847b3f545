"""Table schemas: the union of the declared tables, the columns the
inserts write and the columns the queries read. All columns are nullable;
money is a double, timestamps are instants (``timestamp``)."""

from pyspark.sql import types as T

S, D, B, TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Legacy archive: the timestamp arrives as text 'yyyy-MM-dd HH:mm:ss'.
HISTORICAL_TRANSACTIONS = _struct(
    ("transaction_id", S), ("account_id", S), ("amount", D),
    ("merchant_category", S), ("device_id", S), ("timestamp", S),
)

LIVE_TRANSACTIONS = _struct(
    ("transaction_id", S), ("account_id", S), ("amount", D),
    ("merchant_category", S), ("device_id", S), ("ip_address", S),
    ("shipping_address", S), ("timestamp", TS),
    ("channel", S), ("latitude", D), ("longitude", D),
    ("card_bin", S), ("card_pan_masked", S), ("auth_response_code", S),
)

SCORED_TRANSACTIONS = _struct(
    ("transaction_id", S), ("account_id", S), ("amount", D),
    ("merchant_category", S), ("device_id", S),
    ("is_suspicious_device", B), ("is_high_risk_amount", B),
    ("processed_at", TS),
    ("is_bin_attack", B), ("is_impossible_travel", B),
    ("calculated_speed_kmh", D), ("is_ato", B),
)

AUTH_EVENTS = _struct(
    ("event_id", S), ("account_id", S), ("device_id", S),
    ("ip_address", S), ("event_type", S), ("timestamp", TS),
)

ACCOUNTS = _struct(("account_id", S), ("customer_name", S), ("kyc_status", S))
DEVICES = _struct(("device_id", S), ("device_type", S), ("is_emulator", B))
ADDRESSES = _struct(("address_id", S), ("full_address", S), ("is_commercial_drop", B))
USED_DEVICE = _struct(("account_id", S), ("device_id", S), ("event_type", S), ("timestamp", TS))
SHIPPED_TO = _struct(("account_id", S), ("address_id", S))
TRANSFERS = _struct(
    ("transfer_id", S), ("src_account", S), ("dst_account", S),
    ("amount", D), ("timestamp", TS),
)

KYC_AUDIT_LOG = _struct(
    ("document_uri", S), ("applicant_name", S), ("extracted_address", S),
    ("is_tampered", B), ("confidence_score", D), ("forensic_analysis", S),
    ("graph_syndicate_link", S), ("decision", S), ("scanned_at", TS),
)

HOLDS = _struct(("hold_id", S), ("account_id", S), ("amount", D), ("vector", S), ("held_at", TS))
CARDHOLDER_REPLIES = _struct(("hold_id", S), ("reply", S), ("replied_at", TS))
