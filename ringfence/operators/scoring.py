"""Multi-vector scoring.

``score_batch`` gives exactly one scored row per input row. The narrow input
is decoded and written once with an event key: the transaction id, or a key
of its own for a row without one. Rows that repeat an id are replays: the
first of them is the event the detectors see (a replay adds no attempt, no
amount and no swipe), and every row gets the flags of its event. The flags
are attached with left joins on the event key, unique on their side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as SC
from . import detectors as DT
from .segments import largest, series
from .sliced import DAY_US, HOUR_US, epoch_us
from .triage import MONEY

# Threat vectors, their decision codes and scenario risk scores
# (percent) as the reference displays them.
VECTOR_POLICY = [
    # vector, status_code, risk_score, actions
    ("CLEAN", "AUTH-849201", 0.4, []),
    # ours: approved by the four stored flags, yet with history evidence
    ("REVIEW", "AUTH-849201", 60.0, []),
    ("SYNDICATE", "DECLINE-05 (FRAUD_SUSPECTED)", 99.2,
     ["TEMPORARY_CARD_FREEZE", "SMS_TWO_WAY_VERIFICATION"]),
    ("BIN_ATTACK", "DECLINE-82 (BIN_BURST_ATTACK)", 99.7,
     ["DROP_AUTHORIZATION", "BLOCK_SUBNET_24H"]),
    ("IMPOSSIBLE_TRAVEL", "DECLINE-71 (GEO_VELOCITY_ANOMALY)", 96.8,
     ["BLOCK_TRANSACTION", "PUSH_SMS_BIOMETRIC_CONFIRMATION"]),
    ("ATO", "AUTH_BLOCKED (ATO_FAN_IN)", 98.9,
     ["INVALIDATE_SESSION", "OUT_OF_BAND_IDENTITY_VERIFICATION"]),
]

# Evidence headings per fired check.
EVIDENCE = {
    "is_spend_spike": ("Extreme Spending Spike", "Amount far above the account's trailing baseline."),
    "is_dormant_bust_out": ("Dormant Account Bust-Out", "Large amount after a long idle period."),
    "is_suspicious_device": ("Rooted Hardware Signature", "Emulator or bot device fingerprint."),
    "is_bin_attack": ("High-Velocity BIN Brute Force", "Burst of micro authorisations on one BIN."),
    "is_impossible_travel": ("Impossible Travel Velocity", "Consecutive swipes too far apart for the time between them."),
    "is_high_risk_amount": ("High-Risk Amount", "Amount above the high-risk threshold."),
    "is_ato": ("Account Takeover Fan-In", "One device changed the credentials of several accounts."),
}


# Row classes of the display.
ROW_CLASSES = ("row-new", "row-fraud", "row-clean")


@dataclass(frozen=True)
class ScoringParams:
    high_risk_amount: float = 500.0
    micro_amount: float = 2.0
    bin_window_us: int = 60 * 1_000_000
    bin_min_count: int = 3
    max_kmh: float = 900.0
    spike_days: int = 90
    spike_factor: float = 30.0
    dormant_gap_us: int = 30 * DAY_US
    dormant_min_amount: float = 1000.0
    ato_window_us: int = 4 * 60 * 1_000_000
    ato_min_accounts: int = 3
    ato_hold_us: int = DAY_US      # how long a fan-in marks the account's transactions
    low_cut: float = 50.0          # risk score below -> Low
    critical_cut: float = 98.0     # risk score at or above -> Critical


# Parameters used on the driver's sparse events (FIXTURES.md section 2).
TESTDATA_PARAMS = ScoringParams(
    high_risk_amount=500.0, micro_amount=10.0, bin_window_us=24 * HOUR_US, bin_min_count=3,
    max_kmh=900.0, spike_days=90, spike_factor=5.0, dormant_gap_us=2 * DAY_US,
    dormant_min_amount=50.0, ato_window_us=12 * HOUR_US, ato_min_accounts=3, ato_hold_us=12 * HOUR_US,
)


def policy_table(spark: SparkSession) -> DataFrame:
    """The literal vector policy (five rows; safe to broadcast)."""
    return spark.createDataFrame(
        VECTOR_POLICY, "vector string, status_code string, risk_score double, actions array<string>")


INPUT_COLUMNS = ("transaction_id", "account_id", "amount", "merchant_category", "device_id",
                 "timestamp", "latitude", "longitude", "card_bin")


def scoring_input(txns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow input, written once, with ``__row`` and ``__event``."""
    from ..session import materialize

    narrow = txns.select(*INPUT_COLUMNS, *keep).withColumn("__row", F.monotonically_increasing_id())
    event = F.coalesce(F.concat(F.lit("id:"), F.col("transaction_id").cast("string")),
                       F.concat(F.lit("row:"), F.col("__row").cast("string")))
    return materialize(narrow.withColumn("__event", event), "scoring-input")


def events_of(rows: DataFrame) -> DataFrame:
    """One row per event (``__event``): of its rows the first by timestamp and
    then by all columns, whatever order they are stored in. Written once, as
    two scans read it."""
    from ..session import materialize

    cols = ["timestamp", *(c for c in INPUT_COLUMNS if c not in ("transaction_id", "timestamp"))]
    first = rows.groupBy("__event").agg(F.min(F.struct(*cols)).alias("e"))
    return materialize(first.select("__event", "e.*"), "scoring-events")


def takeovers(auth: DataFrame, p: ScoringParams) -> DataFrame:
    """W4 -> R6: (account_id, t, n_ato) of the auth events of a fan-in, to be summed."""
    rows = auth.select("event_id", "device_id", "account_id", "timestamp")
    fan_in = DT.ato_fan_in_rows(rows, p.ato_window_us, p.ato_min_accounts, episode=True, keep=("__t",))
    return fan_in.select("account_id", F.col("__t").alias("t"), F.lit(1).cast("long").alias("n_ato"))


def event_flags(events: DataFrame, p: ScoringParams, auth: DataFrame | None = None) -> DataFrame:
    """(__event and its history flags): one scan by account, one by BIN."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    one, days = F.lit(1).cast("long"), p.spike_days * DAY_US
    sums = {"baseline_n": (one, -days, -1), "baseline_total": (F.col("amount").cast(MONEY), -days, -1)}
    if auth is not None:
        sums["n_ato"] = (None, -p.ato_hold_us, 0)
    d = events.withColumn("__t", epoch_us("timestamp"))
    most = largest(d, ["account_id"]) + (largest(auth, ["account_id"]) if auth is not None else 0)
    d = series(d, ["account_id"], "__t", sums, {"swipe": (located, ["__t", "latitude", "longitude"]), "before": (F.lit(True), ["__t"])},
               points=takeovers(auth, p) if auth is not None else None, order=["__event"], most=most)
    _, _, speed, jump = DT.travel("swipe.__t", "swipe.latitude", "swipe.longitude", p.max_kmh)
    idle = F.col("__t") - F.col("before.__t")
    known = F.col("account_id").isNotNull()
    d = d.select("__event", "__t", "card_bin", "amount",
                 F.when(located, F.round(speed, 3)).alias("calculated_speed_kmh"), F.when(located, jump).alias("is_impossible_travel"),
                 (known & DT.is_spike(p.spike_factor)).alias("is_spend_spike"),
                 ((idle > F.lit(p.dormant_gap_us)) & (F.col("amount") > F.lit(p.dormant_min_amount))).alias("is_dormant_bust_out"),
                 (F.col("n_ato") > 0 if auth is not None else F.lit(False)).alias("is_ato"))
    micro = F.col("amount") <= F.lit(p.micro_amount)
    d = series(d, ["card_bin"], "__t", {"n_attempts": (F.when(micro, one), -p.bin_window_us, 0)},
               most=largest(events, ["card_bin"]))
    return d.select("__event", "calculated_speed_kmh", "is_impossible_travel", "is_spend_spike", "is_dormant_bust_out", "is_ato",
                    (micro & (F.col("n_attempts") >= p.bin_min_count)).alias("is_bin_attack"))


def flags(txns: DataFrame, devices: DataFrame | None = None,
          p: ScoringParams = ScoringParams(), keep: tuple[str, ...] = (),
          auth: DataFrame | None = None) -> DataFrame:
    """Detector flags (NULL-free booleans) plus speed, one row per input row.
    ``keep`` names extra transaction columns to carry along; ``auth`` adds
    the account-takeover flag (False without it)."""
    rows = scoring_input(txns, keep)
    out = rows.select("__event", "transaction_id", "account_id", "amount", "merchant_category",
                      "device_id", "timestamp", *keep)
    out = out.join(event_flags(events_of(rows), p, auth), "__event", "left")
    out = out.drop("__event")
    emulator = SC.is_emulator("device_id") == 1
    if devices is not None:
        emu = devices.filter(F.col("is_emulator")).select("device_id", F.lit(True).alias("__emu")).distinct()
        out = out.join(emu, "device_id", "left")
        emulator = emulator | SC.null_false("__emu")
    fired = {c: SC.null_false(c) for c in
             ("is_impossible_travel", "is_bin_attack", "is_spend_spike", "is_dormant_bust_out")}
    fired["is_ato"] = SC.null_false("is_ato") if auth is not None else F.lit(False)
    # Emulator fingerprint, or a device caught probing or teleporting.
    fired["is_suspicious_device"] = emulator | fired["is_bin_attack"] | fired["is_impossible_travel"]
    fired["is_high_risk_amount"] = SC.is_high_risk_amount("amount", p.high_risk_amount)
    kept = [c for c in out.columns if c not in fired and c != "__emu"]
    return out.select(*kept, *[v.alias(k) for k, v in fired.items()])


def verdict(df: DataFrame | None = None, include_ato: bool = False) -> Column:
    """BLOCKED when any of the four stored flags is true (NULL = false).
    ``is_ato`` is not part of that formula; ``include_ato`` adds it."""
    fired = (SC.null_false("is_suspicious_device") | SC.null_false("is_high_risk_amount")
             | SC.null_false("is_bin_attack") | SC.null_false("is_impossible_travel"))
    if include_ato:
        fired = fired | SC.null_false("is_ato")
    return F.when(fired, F.lit("BLOCKED")).otherwise(F.lit("APPROVED"))


def classify_vector() -> Column:
    """M5: flags -> threat vector, by precedence ATO > BIN > travel > syndicate."""
    syndicate = (SC.null_false("is_spend_spike") | SC.null_false("is_dormant_bust_out")
                 | SC.null_false("is_suspicious_device") | SC.null_false("is_high_risk_amount"))
    return (F.when(SC.null_false("is_ato"), F.lit("ATO"))
            .when(SC.null_false("is_bin_attack"), F.lit("BIN_ATTACK"))
            .when(SC.null_false("is_impossible_travel"), F.lit("IMPOSSIBLE_TRAVEL"))
            .when(syndicate, F.lit("SYNDICATE"))
            .otherwise(F.lit("CLEAN")))


def risk_level(score: Column | str, p: ScoringParams = ScoringParams()) -> Column:
    """M6: risk score (percent) -> Low / High / Critical."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= F.lit(p.critical_cut), F.lit("Critical"))
            .when(s >= F.lit(p.low_cut), F.lit("High"))
            .otherwise(F.lit("Low")))


def evidence_column() -> Column:
    """array<struct<heading, detail>> of the checks that fired."""
    return SC.evidence(*[(F.col(c), h, d) for c, (h, d) in EVIDENCE.items()])


def score_batch(spark: SparkSession, txns: DataFrame, devices: DataFrame | None = None,
                p: ScoringParams = ScoringParams(), processed_at: str | None = None,
                auth: DataFrame | None = None, include_ato: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One scored row per input row: the stored flags, verdict, vector,
    decision code, risk score and level, evidence headings.

    With ``include_ato`` an account takeover blocks too (P11 alone does not
    know it). A row that stays APPROVED although its history fired (spike,
    dormancy) has the vector REVIEW and an approval code, so no approved row
    carries a decline.

    ``processed_at`` names a transaction column holding the processing time;
    by default ``current_timestamp()`` (one value per query, as the
    reference's inserts have). ``keep`` names more columns to carry."""
    carried = (*keep, processed_at) if processed_at else keep
    f = flags(txns, devices, p, carried, auth).withColumn("verdict", verdict(include_ato=include_ato))
    approved = F.col("verdict") == "APPROVED"
    f = f.withColumn("vector", F.when(approved & (classify_vector() != "CLEAN"), F.lit("REVIEW")).otherwise(classify_vector()))
    pol = F.broadcast(policy_table(spark).select("vector", "status_code", "risk_score"))
    f = f.join(pol, "vector", "left")
    ev = evidence_column()
    return f.select(
        "transaction_id", "account_id", "amount", "merchant_category", "device_id",
        "is_suspicious_device", "is_high_risk_amount", "is_bin_attack", "is_impossible_travel",
        "calculated_speed_kmh", "is_ato", "is_spend_spike", "is_dormant_bust_out",
        (F.col(processed_at) if processed_at else F.current_timestamp()).alias("processed_at"),
        "verdict", "vector", "status_code", "risk_score",
        risk_level("risk_score", p).alias("risk_level"),
        F.array_join(F.transform(ev, lambda x: x["heading"]), "; ").alias("evidence"), *keep,
    )


def mark_new(df: DataFrame, latest_ids: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """``is_new`` when the id is in the latest batch's id set (left join
    on the distinct ids, so duplicates in the id set do not multiply rows)."""
    ids = latest_ids.select(F.col(id_col).alias(id_col)).distinct().withColumn("__hit", F.lit(True))
    return df.join(ids, id_col, "left").withColumn(
        "is_new", SC.null_false("__hit")).drop("__hit")


def row_class(df: DataFrame) -> Column:
    """Display class with precedence new > fraud > clean."""
    new, fraud, clean = ROW_CLASSES
    return (F.when(SC.null_false("is_new"), F.lit(new))
            .when(F.col("verdict") == "BLOCKED", F.lit(fraud)).otherwise(F.lit(clean)))
