"""Scalar column functions (F1-F17, P7-P9, P16). Column -> Column, all
built-in expressions so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference (feature and label rules, display formats).
EMULATOR_PATTERNS = ("%emulator%", "%ring%")
HIGH_RISK_CATEGORY = "high_risk_electronics"
FRAUD_LABEL_PATTERN = "%syndicate%"
MASK_PREFIX = "•••• •••• •••• "
EARTH_RADIUS_KM = 6371.0088


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_emulator(device_id: Column | str) -> Column:
    """Device id LIKE '%emulator%' OR LIKE '%ring%' -> 1/0 (NULL -> 0)."""
    d = _c(device_id).cast("string")
    cond = d.like(EMULATOR_PATTERNS[0]) | d.like(EMULATOR_PATTERNS[1])
    return F.when(cond, 1).otherwise(0)


def is_high_risk(category: Column | str, categories: tuple[str, ...] = (HIGH_RISK_CATEGORY,)) -> Column:
    """Merchant category in the high-risk set -> 1/0."""
    return F.when(_c(category).isin(*categories), 1).otherwise(0)


def fraud_label(account_id: Column | str) -> Column:
    """CASE WHEN account_id LIKE '%syndicate%' THEN 1 ELSE 0."""
    return F.when(_c(account_id).cast("string").like(FRAUD_LABEL_PATTERN), 1).otherwise(0)


def is_high_risk_amount(amount: Column | str, threshold: float = 500.0) -> Column:
    """Amount at or above the threshold (NULL -> false)."""
    return F.coalesce(_c(amount) >= F.lit(threshold), F.lit(False))


def null_false(c: Column | str) -> Column:
    """a boolean where NULL counts as false."""
    return F.coalesce(_c(c), F.lit(False))


def money_text(amount: Column | str) -> Column:
    """'$1,234.50'; negative amounts as '-$1,234.50'."""
    a = _c(amount)
    return F.when(a.isNull(), F.lit(None)).otherwise(
        F.concat(F.when(a < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(a), 2)))


def percent_text(ratio: Column | str) -> Column:
    """F8: confidence 0.992 -> '99.2%'."""
    return F.concat(F.format_number(_c(ratio) * 100, 1), F.lit("%"))


def card_bin(pan: Column | str) -> Column:
    """issuer BIN = first six digits of the PAN."""
    return F.substring(_c(pan), 1, 6)


def mask_pan(pan: Column | str) -> Column:
    """'4111111111111029' -> '411111******1029'."""
    p = _c(pan)
    return F.concat(F.substring(p, 1, 6), F.lit("******"), F.substring(p, -4, 4))


def last4_display(pan: Column | str) -> Column:
    """'•••• •••• •••• 9481'."""
    return F.concat(F.lit(MASK_PREFIX), F.substring(_c(pan), -4, 4))


def ipv4_subnet(ip: Column | str) -> Column:
    """/24 network of a dotted IPv4 address ('198.51.100.24' -> '198.51.100')."""
    return F.substring_index(_c(ip), ".", 3)


def parse_ts(text: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """text timestamp -> timestamp; NULL on malformed text."""
    return F.try_to_timestamp(_c(text), F.lit(fmt))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """great-circle distance in km."""
    lat1, lon1, lat2, lon2 = (_c(x) for x in (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    # rounding may carry a past 1 near antipodes
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


# Auth event type -> feed category (not a plain lower-casing).
AUTH_FEED_CATEGORY = {
    "PASSWORD_RESET": "auth_password_reset",
    "2FA_PHONE_CHANGED": "auth_2fa_phone_change",
}


def auth_category(event_type: Column | str) -> Column:
    """auth event type -> feed category."""
    m = F.create_map(*[F.lit(x) for kv in AUTH_FEED_CATEGORY.items() for x in kv])
    return m[_c(event_type)]


def normalize_address(addr: Column | str) -> Column:
    """F16: linking key for street addresses.

    Upper-case, drop everything after the first comma (city, state), drop a
    trailing unit designator ('STE B', 'SUITE 4', 'UNIT 2', 'APT 3', '#5'),
    collapse whitespace: '104 Industrial Pkwy Ste B, Wilmington DE' and
    '104 Industrial Pkwy' give the same key.
    """
    a = F.upper(F.trim(_c(addr)))
    a = F.regexp_replace(a, r",.*$", "")
    a = F.regexp_replace(a, r"\s+(STE|SUITE|UNIT|APT|#)\s*\.?\s*[A-Z0-9-]+$", "")
    a = F.regexp_replace(a, r"\s+", " ")
    return F.trim(a)


def evidence(*pairs: tuple[Column, str, str]) -> Column:
    """array<struct<heading, detail>> of the checks that fired.

    ``pairs`` are (flag column, heading, detail); NULL flags do not fire.
    """
    items = [F.when(null_false(flag), F.struct(F.lit(h).alias("heading"), F.lit(d).alias("detail")))
             for flag, h, d in pairs]
    return F.filter(F.array(*items), lambda x: x.isNotNull())
