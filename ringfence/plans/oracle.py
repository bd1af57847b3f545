"""Independent SQL statements of every registered query.

DuckDB runs them on the same parquet tables (views named after the files).
They are written the plain way -- nested-loop style joins, window frames,
brute-force walk enumeration -- so they check the Spark plans rather than
mirror them. Column names and types match the Spark output.
"""

from __future__ import annotations

# Domain views over the driver tables (mapping in FIXTURES.md section 2).
_VIEWS = {
    "lines": """SELECT o.o_custkey, l.l_orderkey, l.l_partkey, l.l_suppkey,
                       l.l_extendedprice, l.l_shipdate
                FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "accounts": """SELECT c_custkey AS account_id, c_name AS customer_name,
                          CASE WHEN c_acctbal < -900 THEN 'CONFIRMED_FRAUD'
                               WHEN c_mktsegment = 'BUILDING' AND c_acctbal < -800 THEN 'VICTIM_COMPROMISED'
                               ELSE 'ACTIVE' END AS kyc_status
                   FROM customer""",
    "ud": "SELECT DISTINCT o_custkey AS account_id, l_partkey AS device_id FROM lines",
    "st": "SELECT DISTINCT o_custkey AS account_id, l_suppkey AS address_id FROM lines",
    "xfer": """SELECT DISTINCT l_orderkey AS order_id, o_custkey AS src_account,
                      l_suppkey AS dst_account, l_extendedprice AS amount, l_shipdate AS ts
               FROM lines WHERE o_custkey <> l_suppkey""",
    "ev": """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "txn": """SELECT event_id AS transaction_id, user_id AS account_id, value AS amount,
                     event_type AS merchant_category, k AS device_id,
                     '198.51.' || CAST(k // 10 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip_address,
                     ts,
                     CASE WHEN k % 2 = 0 THEN 'IN_STORE_POS' ELSE 'E_COMMERCE' END AS channel,
                     CAST(k % 25 AS DOUBLE) * 3.0 - 36.0 AS latitude,
                     floor(k / 4) * 12.0 - 150.0 AS longitude,
                     CAST(400000 + k AS VARCHAR) AS card_bin,
                     CAST(400000 + k AS VARCHAR) || '******'
                       || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') AS card_pan_masked,
                     CASE WHEN event_type = 'error' THEN 'DECLINED_CVV' ELSE 'APPROVED' END AS auth_response_code,
                     k
              FROM ev""",
    "auth": """SELECT event_id, user_id AS account_id, k AS device_id,
                      '198.51.' || CAST(k // 10 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip_address,
                      CASE event_type WHEN 'signup' THEN 'PASSWORD_RESET' ELSE '2FA_PHONE_CHANGED' END AS event_type,
                      ts
               FROM ev WHERE event_type IN ('signup', 'error')""",
}

_DEPENDS = {
    "ud": ["lines"], "st": ["lines"], "xfer": ["lines"], "txn": ["ev"], "auth": ["ev"],
}


def with_views(*names: str) -> str:
    """WITH clause defining the named domain views (and what they need)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order) + "\n"


RING_BODY = """
SELECT a.account_id, f.customer_name, e1.device_id, ad.s_name AS full_address
FROM accounts a
JOIN ud e1 ON e1.account_id = a.account_id
JOIN part d ON d.p_partkey = e1.device_id
JOIN ud e2 ON e2.device_id = e1.device_id
JOIN accounts f ON f.account_id = e2.account_id
JOIN st e3 ON e3.account_id = f.account_id
JOIN supplier ad ON ad.s_suppkey = e3.address_id
JOIN st e4 ON e4.address_id = e3.address_id AND e4.account_id = a.account_id
WHERE f.kyc_status = 'CONFIRMED_FRAUD'
"""

EXPOSURE_BODY = """
SELECT o_custkey AS account_id, COUNT(*) AS txns,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_usd
FROM orders GROUP BY o_custkey
"""

SQL: dict[str, str] = {}

SQL["ring_4hop"] = with_views("accounts", "ud", "st") + RING_BODY + " AND a.account_id <> f.account_id"
SQL["ring_4hop_walk"] = with_views("accounts", "ud", "st") + RING_BODY

SQL["exposure_by_account"] = EXPOSURE_BODY

SQL["linked_fraud_exposure"] = with_views("accounts", "ud", "st") + f""",
ring AS ({RING_BODY}),
expo AS ({EXPOSURE_BODY})
SELECT r.account_id AS target, r.customer_name AS linked_fraud_user,
       r.device_id AS shared_device, r.full_address AS drop_address,
       COALESCE(x.txns, 0) AS txns, x.total_usd
FROM ring r LEFT JOIN expo x ON x.account_id = r.account_id
"""

SQL["transfer_paths"] = with_views("accounts", "xfer") + """,
v AS (SELECT t.src_account AS src, t.dst_account AS dst FROM xfer t
      JOIN accounts a1 ON a1.account_id = t.src_account
      JOIN accounts a2 ON a2.account_id = t.dst_account),
seeds AS (SELECT account_id FROM accounts WHERE kyc_status = 'VICTIM_COMPROMISED'),
walks AS (
  SELECT s.account_id AS origin, e1.dst AS destination, 1 AS hop_count
  FROM seeds s JOIN v e1 ON e1.src = s.account_id
  UNION ALL
  SELECT s.account_id, e2.dst, 2
  FROM seeds s JOIN v e1 ON e1.src = s.account_id JOIN v e2 ON e2.src = e1.dst
  UNION ALL
  SELECT s.account_id, e3.dst, 3
  FROM seeds s JOIN v e1 ON e1.src = s.account_id JOIN v e2 ON e2.src = e1.dst
       JOIN v e3 ON e3.src = e2.dst)
SELECT origin, destination, hop_count, COUNT(*) AS n_paths
FROM walks GROUP BY origin, destination, hop_count
"""

DAY_US = 86_400_000_000

SQL["spend_spike"] = with_views("txn") + f"""
, b AS (
  SELECT transaction_id, account_id, amount,
         COUNT(*) OVER w AS baseline_n,
         SUM(CAST(amount AS DECIMAL(18,2))) OVER w AS baseline_total
  FROM txn
  WINDOW w AS (PARTITION BY account_id ORDER BY epoch_us(ts)
               RANGE BETWEEN {90 * DAY_US} PRECEDING AND 1 PRECEDING))
SELECT transaction_id, account_id, amount, baseline_n,
       CAST(baseline_total AS DECIMAL(38,2)) AS baseline_total
FROM b
WHERE baseline_n > 0 AND CAST(amount AS DECIMAL(18,2)) * baseline_n >= 5.0 * baseline_total
"""

SQL["geo_velocity"] = with_views("txn") + """
, p AS (
  SELECT transaction_id, account_id, latitude, longitude, epoch_us(ts) AS t,
         LAG(transaction_id) OVER w AS prev_transaction_id,
         LAG(latitude) OVER w AS plat, LAG(longitude) OVER w AS plon,
         LAG(epoch_us(ts)) OVER w AS pt
  FROM txn WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  WINDOW w AS (PARTITION BY account_id ORDER BY ts, transaction_id)),
d AS (
  SELECT *, 12742.0176 * asin(sqrt(pow(sin(radians(latitude - plat) / 2), 2)
              + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2))) AS dist,
         CAST(t - pt AS DOUBLE) / 1000000.0 AS elapsed_s
  FROM p)
SELECT transaction_id, account_id, prev_transaction_id, round(dist, 3) AS distance_km, elapsed_s,
       round(CASE WHEN pt IS NULL THEN 0.0 WHEN elapsed_s > 0 THEN dist / (elapsed_s / 3600.0) END, 3)
         AS calculated_speed_kmh,
       CASE WHEN pt IS NULL THEN false WHEN elapsed_s > 0 THEN dist / (elapsed_s / 3600.0) > 900
            ELSE dist > 100 END AS is_impossible_travel
FROM d
"""

SQL["bin_velocity_rows"] = with_views("txn") + f"""
, c AS (
  SELECT transaction_id, card_bin,
         COUNT(*) OVER (PARTITION BY card_bin ORDER BY epoch_us(ts)
                        RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS n_attempts
  FROM txn WHERE amount <= 10)
SELECT transaction_id, card_bin, n_attempts FROM c WHERE n_attempts >= 3
"""

SQL["ato_fan_in_rows"] = with_views("auth") + f"""
, a AS (SELECT event_id, device_id, account_id, epoch_us(ts) AS t FROM auth)
SELECT * FROM (
  SELECT x.event_id, x.device_id, x.account_id,
         (SELECT COUNT(DISTINCT y.account_id) FROM a y
          WHERE y.device_id = x.device_id AND y.t BETWEEN x.t - {DAY_US // 2} AND x.t) AS n_accounts
  FROM a x)
WHERE n_accounts >= 3
"""

SQL["dormant_bust_out"] = with_views("txn") + f"""
, g AS (
  SELECT transaction_id, account_id, amount,
         epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY account_id ORDER BY ts, transaction_id) AS gap
  FROM txn)
SELECT transaction_id, account_id, amount, round(CAST(gap AS DOUBLE) / {DAY_US}.0, 6) AS idle_days
FROM g WHERE gap > {2 * DAY_US} AND amount > 50
"""

SQL["sequential_pan"] = with_views("txn") + """
, s AS (
  SELECT transaction_id, card_bin, device_id, card_pan_masked,
         CAST(right(card_pan_masked, 4) AS INTEGER) AS l4,
         LAG(CAST(right(card_pan_masked, 4) AS INTEGER)) OVER w AS pl4,
         LAG(transaction_id) OVER w AS prev_transaction_id
  FROM txn WINDOW w AS (PARTITION BY card_bin, device_id ORDER BY ts, transaction_id))
SELECT transaction_id, card_bin, device_id, card_pan_masked, prev_transaction_id
FROM s WHERE l4 - pl4 = 1
"""

SQL["ato_fan_in"] = with_views("auth") + """
SELECT date_trunc('day', ts) AS window_start, device_id,
       COUNT(DISTINCT account_id) AS n_accounts, COUNT(*) AS n_events,
       min(ts) AS first_seen, max(ts) AS last_seen
FROM auth GROUP BY 1, 2 HAVING COUNT(DISTINCT account_id) >= 3
"""

SQL["bin_velocity"] = with_views("txn") + """
SELECT date_trunc('day', ts) AS window_start, card_bin,
       COUNT(*) AS n_attempts, COUNT(DISTINCT card_pan_masked) AS n_cards
FROM txn WHERE amount <= 10 GROUP BY 1, 2 HAVING COUNT(*) >= 3
"""

SQL["subnet_spread"] = with_views("txn") + """
SELECT date_trunc('day', ts) AS window_start,
       regexp_extract(ip_address, '^([^.]*[.][^.]*[.][^.]*)', 1) AS subnet,
       COUNT(DISTINCT card_pan_masked) AS n_cards,
       CAST(SUM(CASE WHEN auth_response_code LIKE 'DECLINED%' THEN 1 ELSE 0 END) AS BIGINT) AS n_declines,
       COUNT(*) AS n_attempts
FROM txn GROUP BY 1, 2
"""

SQL["smurfing"] = with_views("xfer") + """
, t AS (SELECT DISTINCT order_id, src_account, dst_account, amount, ts FROM xfer)
SELECT i.order_id, i.src_account, i.dst_account, i.amount, i.ts AS "timestamp",
       COUNT(*) AS n_splits,
       CAST(SUM(CAST(o.amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS split_total
FROM t i JOIN t o
  ON o.src_account = i.dst_account AND o.ts >= i.ts AND o.ts <= i.ts + INTERVAL 30 DAY
     AND CAST(o.amount AS DECIMAL(18,2)) < CAST(i.amount AS DECIMAL(18,2))
GROUP BY i.order_id, i.src_account, i.dst_account, i.amount, i.ts
HAVING COUNT(*) >= 3
"""


def _nested(key: str, *views: str) -> str:
    """A registered statement minus its view prefix, usable as a CTE body."""
    body = SQL[key][len(with_views(*views)):].strip()
    return "WITH " + body.lstrip(",").strip() if body.startswith(",") else body


# The policy as SURVEY lists it, written out here so the check is independent.
_POLICY = """SELECT vector, status_code, CAST(risk_score AS DOUBLE) AS risk_score FROM (VALUES
  ('CLEAN', 'AUTH-849201', 0.4), ('REVIEW', 'AUTH-849201', 60.0),
  ('SYNDICATE', 'DECLINE-05 (FRAUD_SUSPECTED)', 99.2), ('BIN_ATTACK', 'DECLINE-82 (BIN_BURST_ATTACK)', 99.7),
  ('IMPOSSIBLE_TRAVEL', 'DECLINE-71 (GEO_VELOCITY_ANOMALY)', 96.8),
  ('ATO', 'AUTH_BLOCKED (ATO_FAN_IN)', 98.9)) p(vector, status_code, risk_score)"""

_ACTIONS = """SELECT * FROM (VALUES
  ('SYNDICATE', 0, 'TEMPORARY_CARD_FREEZE'), ('SYNDICATE', 1, 'SMS_TWO_WAY_VERIFICATION'),
  ('BIN_ATTACK', 0, 'DROP_AUTHORIZATION'), ('BIN_ATTACK', 1, 'BLOCK_SUBNET_24H'),
  ('IMPOSSIBLE_TRAVEL', 0, 'BLOCK_TRANSACTION'), ('IMPOSSIBLE_TRAVEL', 1, 'PUSH_SMS_BIOMETRIC_CONFIRMATION'),
  ('ATO', 0, 'INVALIDATE_SESSION'), ('ATO', 1, 'OUT_OF_BAND_IDENTITY_VERIFICATION')) p(vector, action_seq, action)"""


SCORED = with_views("txn", "auth") + f""",
auth_t AS (SELECT event_id, device_id, account_id, epoch_us(ts) AS t FROM auth),
auth_n AS (SELECT x.*, (SELECT COUNT(DISTINCT y.account_id) FROM auth_t y
                        WHERE y.device_id = x.device_id AND y.t BETWEEN x.t - {DAY_US // 2} AND x.t) AS n FROM auth_t x),
fan_in AS (SELECT a.account_id, a.t FROM auth_n a
           WHERE EXISTS (SELECT 1 FROM auth_n f WHERE f.n >= 3 AND f.device_id = a.device_id AND f.t BETWEEN a.t AND a.t + {DAY_US // 2})),
ato AS (SELECT t.transaction_id FROM txn t
        WHERE EXISTS (SELECT 1 FROM fan_in f WHERE f.account_id = t.account_id
                      AND f.t BETWEEN epoch_us(t.ts) - {DAY_US // 2} AND epoch_us(t.ts))),
dev AS (SELECT p_partkey AS device_id FROM part WHERE p_name LIKE '%ring%'),
travel AS ({_nested("geo_velocity", "txn")}),
bins AS ({_nested("bin_velocity_rows", "txn")}),
spike AS ({_nested("spend_spike", "txn")}),
dormant AS ({_nested("dormant_bust_out", "txn")}),
flags AS (
  SELECT t.transaction_id, t.account_id, t.amount, t.merchant_category, t.device_id, t.ts, t.k,
         COALESCE(tr.is_impossible_travel, false) AS is_impossible_travel,
         tr.calculated_speed_kmh,
         b.transaction_id IS NOT NULL AS is_bin_attack,
         s.transaction_id IS NOT NULL AS is_spend_spike,
         d.transaction_id IS NOT NULL AS is_dormant_bust_out,
         COALESCE(t.amount >= 500, false) AS is_high_risk_amount,
         t.transaction_id IN (SELECT transaction_id FROM ato) AS is_ato,
         (CAST(t.device_id AS VARCHAR) LIKE '%emulator%' OR CAST(t.device_id AS VARCHAR) LIKE '%ring%'
          OR dv.device_id IS NOT NULL) AS is_emu
  FROM txn t
  LEFT JOIN travel tr ON tr.transaction_id = t.transaction_id
  LEFT JOIN bins b ON b.transaction_id = t.transaction_id
  LEFT JOIN spike s ON s.transaction_id = t.transaction_id
  LEFT JOIN dormant d ON d.transaction_id = t.transaction_id
  LEFT JOIN dev dv ON dv.device_id = t.device_id),
f2 AS (SELECT *, (is_emu OR is_bin_attack OR is_impossible_travel) AS is_suspicious_device FROM flags),
f3 AS (
  SELECT *,
         CASE WHEN is_suspicious_device OR is_high_risk_amount OR is_bin_attack OR is_impossible_travel OR is_ato
              THEN 'BLOCKED' ELSE 'APPROVED' END AS verdict,
         CASE WHEN is_ato THEN 'ATO' WHEN is_bin_attack THEN 'BIN_ATTACK'
              WHEN is_impossible_travel THEN 'IMPOSSIBLE_TRAVEL'
              WHEN is_suspicious_device OR is_high_risk_amount THEN 'SYNDICATE'
              WHEN is_spend_spike OR is_dormant_bust_out THEN 'REVIEW' ELSE 'CLEAN' END AS vector
  FROM f2),
policy AS ({_POLICY}),
scored AS (
  SELECT f3.transaction_id, f3.account_id, f3.amount, f3.merchant_category, f3.device_id,
         is_suspicious_device, is_high_risk_amount, is_bin_attack, is_impossible_travel,
         calculated_speed_kmh, is_ato, is_spend_spike, is_dormant_bust_out,
         f3.ts + to_seconds(f3.k) AS processed_at, verdict, f3.vector, p.status_code, p.risk_score,
         CASE WHEN p.risk_score >= 98.0 THEN 'Critical' WHEN p.risk_score >= 50.0 THEN 'High'
              ELSE 'Low' END AS risk_level,
         concat_ws('; ',
           CASE WHEN is_spend_spike THEN 'Extreme Spending Spike' END,
           CASE WHEN is_dormant_bust_out THEN 'Dormant Account Bust-Out' END,
           CASE WHEN is_suspicious_device THEN 'Rooted Hardware Signature' END,
           CASE WHEN is_bin_attack THEN 'High-Velocity BIN Brute Force' END,
           CASE WHEN is_impossible_travel THEN 'Impossible Travel Velocity' END,
           CASE WHEN is_high_risk_amount THEN 'High-Risk Amount' END,
           CASE WHEN is_ato THEN 'Account Takeover Fan-In' END) AS evidence
  FROM f3 LEFT JOIN policy p ON p.vector = f3.vector)
"""

RESOLVED = SCORED + """,
holds AS (SELECT transaction_id AS hold_id, account_id, amount, vector FROM scored WHERE verdict = 'BLOCKED'),
nxt AS (
  SELECT transaction_id, LEAD(merchant_category) OVER w AS next_type, LEAD(ts) OVER w AS next_ts
  FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY ts, transaction_id)),
replies AS (
  SELECT n.transaction_id AS hold_id,
         CASE n.next_type WHEN 'click' THEN '1' WHEN 'error' THEN '2' END AS reply,
         n.next_ts AS replied_at
  FROM nxt n JOIN holds h ON h.hold_id = n.transaction_id),
resolved AS (
  SELECT h.hold_id, h.account_id, h.amount, h.vector, r.reply, r.replied_at,
         CASE r.reply WHEN '1' THEN 'RELEASED' WHEN '2' THEN 'BLOCKED_PERMANENT' ELSE 'PENDING' END AS status
  FROM holds h LEFT JOIN (SELECT * FROM replies WHERE reply IS NOT NULL) r ON r.hold_id = h.hold_id)
"""

SQL["verdict"] = SCORED + """
SELECT transaction_id, is_suspicious_device, is_high_risk_amount, is_bin_attack, is_impossible_travel,
       CASE WHEN is_suspicious_device OR is_high_risk_amount OR is_bin_attack OR is_impossible_travel
            THEN 'BLOCKED' ELSE 'APPROVED' END AS verdict
FROM scored
"""

SQL["score_batch"] = SCORED + "SELECT * FROM scored"

SQL["row_class"] = SCORED + """,
latest AS (SELECT transaction_id FROM txn ORDER BY ts DESC, transaction_id DESC LIMIT 100)
SELECT s.transaction_id, s.verdict, l.transaction_id IS NOT NULL AS is_new,
       CASE WHEN l.transaction_id IS NOT NULL THEN 'row-new'
            WHEN s.verdict = 'BLOCKED' THEN 'row-fraud' ELSE 'row-clean' END AS row_class
FROM scored s LEFT JOIN latest l ON l.transaction_id = s.transaction_id
"""

SQL["raw_feed_latest"] = with_views("txn") + """
SELECT transaction_id, account_id, amount, merchant_category,
       COALESCE(card_bin, 'N/A') AS bin, COALESCE(channel, 'POS') AS channel
FROM txn ORDER BY ts DESC, transaction_id DESC LIMIT 5
"""

SQL["scored_feed_latest"] = SCORED + """
SELECT transaction_id, account_id, amount, is_bin_attack, is_impossible_travel,
       is_suspicious_device, is_high_risk_amount
FROM scored ORDER BY processed_at DESC, transaction_id DESC LIMIT 5
"""

SQL["unified_feed"] = with_views("txn", "auth") + """
SELECT transaction_id, account_id, amount, merchant_category, COALESCE(card_bin, 'N/A') AS bin,
       COALESCE(channel, 'POS') AS channel, ts AS "timestamp"
FROM txn WHERE merchant_category NOT IN ('signup', 'error')
UNION ALL
SELECT event_id, account_id, CAST(0.0 AS DOUBLE),
       CASE event_type WHEN 'PASSWORD_RESET' THEN 'auth_password_reset'
                       WHEN '2FA_PHONE_CHANGED' THEN 'auth_2fa_phone_change' END,
       'N/A', 'MOBILE_AUTH', ts
FROM auth
"""

SQL["enrich"] = with_views("txn", "accounts") + """
SELECT t.transaction_id, t.account_id, t.device_id, t.amount, a.customer_name, a.kyc_status,
       p.p_type AS device_type, p.p_name LIKE '%ring%' AS is_emulator
FROM txn t LEFT JOIN accounts a ON a.account_id = t.account_id
LEFT JOIN part p ON p.p_partkey = t.device_id
"""

SQL["screen_blocklist"] = with_views("txn") + f""",
blocks AS (SELECT k AS device_id, epoch_us(ts) AS b FROM ev WHERE event_type = 'error' AND value > 200)
SELECT * FROM (
  SELECT t.transaction_id, t.device_id,
         (SELECT COUNT(*) FROM blocks x WHERE x.device_id = t.device_id
            AND x.b > epoch_us(t.ts) - {DAY_US} AND x.b <= epoch_us(t.ts)) AS n_active_blocks
  FROM txn t)
WHERE n_active_blocks > 0
"""

SQL["active_blocklist"] = with_views("ev") + """,
blocks AS (SELECT k AS device_id, ts AS blocked_at FROM ev WHERE event_type = 'error' AND value > 200)
SELECT device_id, max(blocked_at) AS last_blocked_at, max(blocked_at) + INTERVAL 24 HOUR AS expires_at
FROM blocks GROUP BY device_id
HAVING max(blocked_at) + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)
"""

SQL["screen_subnet_blocks"] = SCORED + f""",
net AS (SELECT transaction_id, regexp_extract(ip_address, '^([^.]*[.][^.]*[.][^.]*)', 1) AS subnet, epoch_us(ts) AS t FROM txn),
blk AS (SELECT n.subnet, epoch_us(s.processed_at) AS b FROM scored s JOIN net n USING (transaction_id)
        WHERE s.verdict = 'BLOCKED' AND s.vector = 'BIN_ATTACK')
SELECT * FROM (
  SELECT n.transaction_id, n.subnet,
         (SELECT COUNT(*) FROM blk WHERE blk.subnet = n.subnet AND blk.b > n.t - {DAY_US} AND blk.b <= n.t) AS n_active_blocks
  FROM net n)
WHERE n_active_blocks > 0
"""

SQL["containment_actions"] = SCORED + f""",
pol AS ({_ACTIONS})
SELECT s.transaction_id, s.account_id, s.vector, p.action_seq, p.action
FROM scored s JOIN pol p ON p.vector = s.vector WHERE s.verdict = 'BLOCKED'
"""

SQL["resolve_holds"] = RESOLVED + "SELECT * FROM resolved"

SQL["false_positive_rate"] = RESOLVED + """,
c AS (SELECT COUNT(*) AS n_blocked,
             CAST(SUM(CASE WHEN status = 'RELEASED' THEN 1 ELSE 0 END) AS BIGINT) AS n_false_positive
      FROM resolved)
SELECT n_blocked, n_false_positive, round(n_false_positive / NULLIF(n_blocked, 0), 6) AS false_positive_rate
FROM c
"""

SQL["incident_exposure"] = RESOLVED + """
SELECT account_id, COUNT(*) AS n_holds,
       CAST(SUM(CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END) AS BIGINT) AS n_pending,
       CAST(SUM(CASE WHEN status = 'BLOCKED_PERMANENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_contained,
       COALESCE(CAST(SUM(CASE WHEN status = 'PENDING' THEN CAST(amount AS DECIMAL(18,2)) END)
                     AS DECIMAL(38,2)), 0) AS pending_amount
FROM resolved GROUP BY account_id
"""

SQL["prevented_by_day"] = SCORED + """
SELECT CAST(processed_at AS DATE) AS day,
       CAST(SUM(CASE WHEN verdict = 'BLOCKED' THEN 1 ELSE 0 END) AS BIGINT) AS n_blocked,
       COALESCE(CAST(SUM(CASE WHEN verdict = 'BLOCKED' THEN CAST(amount AS DECIMAL(18,2)) END)
                     AS DECIMAL(38,2)), 0) AS prevented_total
FROM scored GROUP BY 1
"""

SQL["decision_latency"] = SCORED + """
SELECT CAST(t.ts AS DATE) AS day, COUNT(*) AS n,
       CAST(SUM(epoch_us(s.processed_at) - epoch_us(t.ts)) AS BIGINT) AS total_latency_us,
       MAX(epoch_us(s.processed_at) - epoch_us(t.ts)) AS max_latency_us
FROM txn t JOIN scored s ON s.transaction_id = t.transaction_id GROUP BY 1
"""

SQL["triage_dossier"] = SCORED + f""",
{with_views("accounts", "ud", "st")[5:]},
ring AS (
  SELECT a.account_id AS suspicious_id, f.account_id AS fraud_id
  FROM accounts a
  JOIN ud e1 ON e1.account_id = a.account_id
  JOIN part d ON d.p_partkey = e1.device_id
  JOIN ud e2 ON e2.device_id = e1.device_id
  JOIN accounts f ON f.account_id = e2.account_id
  JOIN st e3 ON e3.account_id = f.account_id
  JOIN supplier ad ON ad.s_suppkey = e3.address_id
  JOIN st e4 ON e4.address_id = e3.address_id AND e4.account_id = a.account_id
  WHERE f.kyc_status = 'CONFIRMED_FRAUD' AND a.account_id <> f.account_id),
alerts AS (
  SELECT account_id, CAST(SUM(CASE WHEN verdict = 'BLOCKED' THEN 1 ELSE 0 END) AS BIGINT) AS n_alerts,
         COALESCE(CAST(SUM(CASE WHEN verdict = 'BLOCKED' THEN CAST(amount AS DECIMAL(18,2)) END)
                       AS DECIMAL(38,2)), 0) AS blocked_total,
         bool_or(is_spend_spike) AS e1, bool_or(is_dormant_bust_out) AS e2, bool_or(is_suspicious_device) AS e3,
         bool_or(is_bin_attack) AS e4, bool_or(is_impossible_travel) AS e5, bool_or(is_high_risk_amount) AS e6, bool_or(is_ato) AS e7
  FROM scored GROUP BY account_id),
kyc AS (SELECT doc_id AS account_id, COUNT(*) AS n_documents,
               CAST(SUM(CASE WHEN COALESCE(toxic <> 1, false) AND COALESCE(quality <> 0, false) THEN 0 ELSE 1 END) AS BIGINT) AS n_rejected
        FROM labels GROUP BY doc_id),
rs AS (SELECT suspicious_id AS account_id, COUNT(*) AS n_ring_matches,
              COUNT(DISTINCT fraud_id) AS n_linked_fraud FROM ring GROUP BY 1),
d AS (
  SELECT COALESCE(a.account_id, r.account_id) AS account_id,
         COALESCE(n_alerts, 0) AS n_alerts, COALESCE(blocked_total, 0) AS blocked_total,
         COALESCE(n_ring_matches, 0) AS n_ring_matches, COALESCE(n_linked_fraud, 0) AS n_linked_fraud,
         e1, e2, e3, e4, e5, e6, e7
  FROM alerts a FULL OUTER JOIN rs r ON r.account_id = a.account_id),
expo AS ({EXPOSURE_BODY})
SELECT d.account_id, n_alerts, blocked_total, n_ring_matches, n_linked_fraud,
       COALESCE(n_documents, 0) AS n_documents, COALESCE(n_rejected, 0) AS n_rejected, COALESCE(x.txns, 0) AS txns, x.total_usd,
       concat_ws('; ',
         CASE WHEN e1 THEN 'Extreme Spending Spike: Amount far above the account''s trailing baseline.' END,
         CASE WHEN e2 THEN 'Dormant Account Bust-Out: Large amount after a long idle period.' END,
         CASE WHEN e3 THEN 'Rooted Hardware Signature: Emulator or bot device fingerprint.' END,
         CASE WHEN e4 THEN 'High-Velocity BIN Brute Force: Burst of micro authorisations on one BIN.' END,
         CASE WHEN e5 THEN 'Impossible Travel Velocity: Consecutive swipes too far apart for the time between them.' END,
         CASE WHEN e6 THEN 'High-Risk Amount: Amount above the high-risk threshold.' END,
         CASE WHEN e7 THEN 'Account Takeover Fan-In: One device changed the credentials of several accounts.' END,
         CASE WHEN n_linked_fraud > 0 THEN 'Syndicate Graph Link: Shares a device and an address with confirmed fraud accounts: ' || n_linked_fraud END,
         CASE WHEN n_rejected > 0 THEN 'Identity Documents Rejected: ' || n_rejected || ' of ' || n_documents END) AS evidence
FROM d LEFT JOIN expo x ON x.account_id = d.account_id LEFT JOIN kyc ON kyc.account_id = d.account_id
WHERE d.n_alerts > 0 OR d.n_ring_matches > 0
"""

_ASSESS = """
SELECT 'doc://kyc/' || CAST(doc_id AS VARCHAR) AS document_uri,
       NOT COALESCE(quality <> 0, false) AS is_tampered,
       concat_ws(',', CASE WHEN NOT COALESCE(toxic <> 1, false) THEN 'portrait' END,
                      CASE WHEN NOT COALESCE(quality <> 0, false) THEN 'document' END) AS failed_checks,
       CASE WHEN NOT COALESCE(toxic <> 1, false) THEN 'REJECT_DEEPFAKE_PORTRAIT'
            WHEN NOT COALESCE(quality <> 0, false) THEN 'REJECT_FORGED_ID' ELSE 'APPROVE' END AS decision
FROM labels
"""

SQL["kyc_assess"] = f"""
SELECT *, CASE WHEN decision LIKE '%REJECT%' THEN 'REJECT' ELSE 'APPROVE' END AS kyc_verdict
FROM ({_ASSESS})
"""

SQL["kyc_summary"] = f"""
SELECT decision, COUNT(*) AS n_documents,
       CAST(SUM(CASE WHEN is_tampered THEN 1 ELSE 0 END) AS BIGINT) AS n_tampered,
       round(AVG(confidence_score), 6) AS avg_confidence
FROM ({_ASSESS}) JOIN (SELECT 'doc://kyc/' || CAST(doc_id AS VARCHAR) AS document_uri,
                              1.0 - CAST(doc_id % 40 AS DOUBLE) / 100.0 AS confidence_score FROM labels) USING (document_uri)
GROUP BY decision
"""


def _norm_sql(x: str) -> str:
    a = f"upper(trim({x}))"
    a = f"regexp_replace({a}, ',.*$', '')"
    a = f"regexp_replace({a}, '\\s+(STE|SUITE|UNIT|APT|#)\\s*\\.?\\s*[A-Z0-9-]+$', '')"
    a = f"regexp_replace({a}, '\\s+', ' ', 'g')"
    return f"trim({a})"


SQL["kyc_graph_link"] = with_views("accounts", "st") + f""",
fa AS (
  SELECT st.address_id, st.account_id, a.customer_name
  FROM st JOIN accounts a ON a.account_id = st.account_id WHERE a.kyc_status = 'CONFIRMED_FRAUD'),
fk AS (
  SELECT {_norm_sql("s.s_name")} AS address_key, COUNT(DISTINCT fa.account_id) AS n_linked_fraud,
         MIN(customer_name) AS fraud_name
  FROM fa JOIN supplier s ON s.s_suppkey = fa.address_id GROUP BY 1),
docs AS (
  SELECT 'doc://kyc/' || CAST(l.doc_id AS VARCHAR) AS document_uri, s.s_name AS extracted_address
  FROM labels l LEFT JOIN supplier s ON s.s_suppkey = l.doc_id % 100)
SELECT d.document_uri, d.extracted_address, COALESCE(fk.n_linked_fraud, 0) AS n_linked_fraud,
       CASE WHEN COALESCE(fk.n_linked_fraud, 0) > 0
            THEN 'Direct Link to ' || fk.fraud_name || ' via ' || d.extracted_address
            ELSE 'No adverse graph links.' END AS graph_syndicate_link
FROM docs d LEFT JOIN fk ON fk.address_key = {_norm_sql("d.extracted_address")}
"""

SQL["graph_violations"] = """
SELECT 'duplicate_key' AS violation, 'lineitem' AS table_name,
       concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS key_text,
       COUNT(*) AS n_rows
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
UNION ALL
SELECT 'duplicate_key', 'orders', CAST(o_orderkey AS VARCHAR), COUNT(*) FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1
UNION ALL
SELECT 'duplicate_key', 'supplier', CAST(s_suppkey AS VARCHAR), COUNT(*) FROM supplier GROUP BY s_suppkey HAVING COUNT(*) > 1
UNION ALL
SELECT 'duplicate_key', 'part', CAST(p_partkey AS VARCHAR), COUNT(*) FROM part GROUP BY p_partkey HAVING COUNT(*) > 1
UNION ALL
SELECT 'duplicate_key', 'customer', CAST(c_custkey AS VARCHAR), COUNT(*) FROM customer GROUP BY c_custkey HAVING COUNT(*) > 1
UNION ALL
SELECT 'dangling_o_custkey', 'orders', CAST(o_custkey AS VARCHAR), COUNT(*) FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey) GROUP BY o_custkey
UNION ALL
SELECT 'dangling_l_orderkey', 'lineitem', CAST(l_orderkey AS VARCHAR), COUNT(*) FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) GROUP BY l_orderkey
UNION ALL
SELECT 'dangling_l_partkey', 'lineitem', CAST(l_partkey AS VARCHAR), COUNT(*) FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey) GROUP BY l_partkey
UNION ALL
SELECT 'dangling_l_suppkey', 'lineitem', CAST(l_suppkey AS VARCHAR), COUNT(*) FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey) GROUP BY l_suppkey
"""

_EMU = """,
emu AS (SELECT ud.* FROM ud JOIN part p ON p.p_partkey = ud.device_id WHERE p.p_name LIKE '%ring%')
"""

SQL["shared_device_pairs"] = with_views("accounts", "ud") + _EMU + """,
seeds AS (SELECT account_id FROM accounts WHERE kyc_status = 'CONFIRMED_FRAUD')
SELECT s.account_id AS seed_account, e2.account_id AS linked_account, COUNT(*) AS shared_devices
FROM seeds s JOIN emu e1 ON e1.account_id = s.account_id JOIN emu e2 ON e2.device_id = e1.device_id
WHERE e2.account_id <> s.account_id GROUP BY 1, 2
"""

SQL["blast_radius"] = with_views("ud") + _EMU + """
SELECT device_id, COUNT(DISTINCT account_id) AS n_accounts FROM emu GROUP BY device_id
"""

SQL["blast_radius_members"] = with_views("ud") + _EMU + """,
d AS (SELECT DISTINCT device_id, account_id FROM emu WHERE account_id IS NOT NULL),
n AS (SELECT device_id, CAST(ceil(COUNT(*) / 8.0) AS BIGINT) AS n_pages FROM d GROUP BY device_id),
p AS (SELECT d.device_id, d.account_id, n.n_pages,
             CAST('0x' || substr(md5(CAST(d.account_id AS VARCHAR)), 1, 8) AS BIGINT) % n.n_pages AS page
      FROM d JOIN n USING (device_id))
SELECT device_id, n_pages, page, COUNT(*) AS n_members,
       string_agg(CAST(account_id AS VARCHAR), ',' ORDER BY account_id) AS members
FROM p GROUP BY device_id, n_pages, page
"""

SQL["device_fan_in"] = with_views("auth", "accounts") + """
SELECT a.device_id, a.account_id, c.customer_name, a.event_type, a.ts AS "timestamp"
FROM auth a JOIN accounts c ON c.account_id = a.account_id
WHERE a.device_id IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%')
"""

SQL["scalar_formats"] = """
WITH s AS (
  SELECT c_custkey, c_acctbal, c_mktsegment,
         '4' || lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS pan,
         concat_ws('.', '10', CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 256 AS VARCHAR),
                   CAST(c_custkey % 7 AS VARCHAR)) AS ip_address,
         (c_custkey % 1000) / 1000.0 AS ratio
  FROM customer)
SELECT c_custkey,
       CASE WHEN c_acctbal IS NULL THEN NULL
            ELSE (CASE WHEN c_acctbal < 0 THEN '-$' ELSE '$' END) || format('{:,.2f}', abs(c_acctbal)) END
         AS balance_text,
       format('{:,.1f}', ratio * 100) || '%' AS ratio_text,
       substr(pan, 1, 6) AS card_bin,
       substr(pan, 1, 6) || '******' || right(pan, 4) AS pan_masked,
       '•••• •••• •••• ' || right(pan, 4) AS pan_display,
       regexp_extract(ip_address, '^([^.]*[.][^.]*[.][^.]*)', 1) AS subnet,
       COALESCE(c_mktsegment, 'UNKNOWN') AS segment,
       contains(c_mktsegment, 'BUILD') AS is_building
FROM s
"""

SQL["modernize_roundtrip"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS account_id,
       o_totalprice AS amount, o_orderstatus AS merchant_category, CAST(NULL AS VARCHAR) AS device_id,
       date_trunc('second', o_orderdate) AS "timestamp"
FROM orders
"""

SQL["conform_append"] = with_views("ev") + """
SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS account_id,
       value AS amount, event_type AS merchant_category, CAST(k AS VARCHAR) AS device_id,
       CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS shipping_address, ts AS "timestamp",
       CAST(NULL AS VARCHAR) AS channel, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       CAST(NULL AS VARCHAR) AS card_bin, CAST(NULL AS VARCHAR) AS card_pan_masked,
       CAST(NULL AS VARCHAR) AS auth_response_code
FROM ev
"""

SQL["fraud_features"] = """
SELECT l.l_orderkey, l.l_partkey, l.l_extendedprice AS amount,
       CASE WHEN p.p_name LIKE '%emulator%' OR p.p_name LIKE '%ring%' THEN 1 ELSE 0 END AS is_emulator,
       CASE WHEN p.p_type IN ('high_risk_electronics') THEN 1 ELSE 0 END AS is_high_risk,
       CASE WHEN c.c_acctbal < -900 THEN 1 ELSE 0 END AS is_fraud
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey JOIN customer c ON c.c_custkey = o.o_custkey
"""

SQL["document_manifest"] = """
SELECT 'doc://documents/' || CAST(doc_id AS VARCHAR) AS document_uri, source,
       CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(length(text) AS BIGINT) AS n_chars
FROM documents
"""

SQL["predict_rows"] = """
SELECT l.l_orderkey, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN c.c_acctbal < -900 THEN 1 ELSE 0 END) AS BIGINT) AS n_fraud
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
JOIN customer c ON c.c_custkey = o.o_custkey
WHERE (l.l_orderkey * 48271 % 2147483647) % 5 = 0 GROUP BY l.l_orderkey
"""

SQL["stream_score"] = with_views("txn") + """
SELECT t.transaction_id, t.account_id, t.amount,
       (CAST(t.device_id AS VARCHAR) LIKE '%emulator%' OR CAST(t.device_id AS VARCHAR) LIKE '%ring%'
        OR p.p_partkey IS NOT NULL) AS is_suspicious_device,
       COALESCE(t.amount >= 500, false) AS is_high_risk_amount
FROM txn t LEFT JOIN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%') p ON p.p_partkey = t.device_id
"""

SQL["stream_bin"] = with_views("txn") + """,
m AS (SELECT card_bin, ts, time_bucket(INTERVAL 12 HOUR, ts) AS b FROM txn WHERE amount <= 10),
w AS (SELECT card_bin, b AS window_start FROM m UNION ALL SELECT card_bin, b - INTERVAL 12 HOUR FROM m)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, card_bin, COUNT(*) AS n_attempts
FROM w GROUP BY window_start, card_bin
HAVING COUNT(*) >= 3
"""

SQL["stream_ato"] = with_views("auth") + """
SELECT * FROM (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
         device_id, COUNT(DISTINCT account_id) AS n_accounts, COUNT(*) AS n_events
  FROM auth GROUP BY 1, 2, 3)
WHERE n_accounts >= 3
"""

SQL["stream_geo"] = SQL["geo_velocity"]

SQL["stream_spike"] = with_views("txn") + """,
prof AS (SELECT account_id, COUNT(*) AS baseline_n, SUM(CAST(amount AS DECIMAL(18,2))) AS baseline_total
         FROM txn WHERE ts < TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2024-01-15' - INTERVAL 90 DAY GROUP BY account_id)
SELECT t.transaction_id, t.account_id, t.amount, p.baseline_n,
       CAST(p.baseline_total AS DECIMAL(38,2)) AS baseline_total
FROM txn t JOIN prof p ON p.account_id = t.account_id
WHERE t.ts >= TIMESTAMP '2024-01-15' AND CAST(t.amount AS DECIMAL(18,2)) * p.baseline_n >= 5.0 * p.baseline_total
"""

SQL["stream_spike_profile"] = with_views("txn") + """,
daily AS (SELECT account_id, CAST(ts AS DATE) AS d, COUNT(*) AS n, SUM(CAST(amount AS DECIMAL(18,2))) AS total FROM txn GROUP BY 1, 2),
prof AS (SELECT a.account_id, a.d, SUM(b.n) AS n, SUM(b.total) AS total FROM daily a JOIN daily b
         ON b.account_id = a.account_id AND b.d BETWEEN a.d - 10 AND a.d - 1 GROUP BY 1, 2)
SELECT CAST(t.transaction_id AS VARCHAR) AS transaction_id, CAST(t.account_id AS VARCHAR) AS account_id, t.amount,
       t.ts AS "timestamp", CAST(p.n AS BIGINT) AS baseline_n, CAST(p.total AS DECIMAL(38,2)) AS baseline_total
FROM txn t JOIN prof p ON p.account_id = t.account_id AND p.d = CAST(t.ts AS DATE)
WHERE CAST(t.amount AS DECIMAL(18,2)) * p.n >= 5.0 * p.total
"""

SQL["stream_blocklist"] = SQL["active_blocklist"]

SQL["stream_scored"] = SCORED + """
SELECT transaction_id, account_id, is_bin_attack, is_impossible_travel, is_spend_spike, is_dormant_bust_out,
       CASE WHEN is_suspicious_device OR is_high_risk_amount OR is_bin_attack OR is_impossible_travel
            THEN 'BLOCKED' ELSE 'APPROVED' END AS verdict
FROM scored
"""

SQL["stream_scored_ato"] = SCORED + """
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(account_id AS VARCHAR) AS account_id, is_bin_attack,
       is_impossible_travel, is_spend_spike, is_dormant_bust_out, is_ato, verdict, vector
FROM scored
"""

SQL["stream_replays"] = with_views("txn") + """
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(account_id AS VARCHAR) AS account_id, amount, ts AS "timestamp" FROM txn
"""

SQL["stream_holds"] = RESOLVED + """
SELECT CAST(hold_id AS VARCHAR) AS hold_id, CAST(account_id AS VARCHAR) AS account_id, amount, vector, reply, replied_at, status FROM resolved
"""

SQL["investigate_targets"] = with_views("accounts", "ud", "st", "ev") + f""",
ring AS ({RING_BODY}),
expo AS ({EXPOSURE_BODY})
SELECT r.account_id AS target, r.customer_name AS linked_fraud_user, r.device_id AS shared_device, r.full_address AS drop_address,
       COALESCE(x.txns, 0) AS txns, x.total_usd
FROM ring r LEFT JOIN expo x ON x.account_id = r.account_id
WHERE r.account_id IN (SELECT user_id FROM ev WHERE event_type = 'error' AND value > 100)
"""

SQL["account_exposure"] = """
SELECT COUNT(*) AS txns, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_usd
FROM orders WHERE o_custkey = (SELECT user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
"""

SQL["commercial_drop_links"] = with_views("accounts", "st") + """
SELECT s.s_suppkey AS address_id, s.s_name AS full_address, COUNT(DISTINCT st.account_id) AS n_fraud_accounts
FROM st JOIN accounts a ON a.account_id = st.account_id AND a.kyc_status = 'CONFIRMED_FRAUD'
JOIN supplier s ON s.s_suppkey = st.address_id WHERE s.s_acctbal < 0 GROUP BY 1, 2
"""

SQL["decision_latency_percentiles"] = SCORED + """,
lat AS (SELECT CAST(t.ts AS DATE) AS day, epoch_us(s.processed_at) - epoch_us(t.ts) AS us
        FROM txn t JOIN scored s ON s.transaction_id = t.transaction_id)
SELECT day, round(SUM(us) / COUNT(*) / 1e6, 6) AS mean_s, round(quantile_disc(us, 0.5) / 1e6, 6) AS p50_s,
       round(quantile_disc(us, 0.95) / 1e6, 6) AS p95_s, round(quantile_disc(us, 0.99) / 1e6, 6) AS p99_s
FROM lat GROUP BY day
"""

SQL["bin_velocity_episodes"] = with_views("txn") + f""",
m AS (SELECT transaction_id, card_bin, epoch_us(ts) AS t FROM txn WHERE amount <= 10),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY card_bin ORDER BY t
                               RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS n FROM m),
f AS (SELECT card_bin, t FROM c WHERE n >= 3)
SELECT m.transaction_id, m.card_bin FROM m
WHERE EXISTS (SELECT 1 FROM f WHERE f.card_bin = m.card_bin AND f.t BETWEEN m.t AND m.t + {DAY_US})
"""

SQL["ato_fan_in_episodes"] = with_views("auth") + f""",
a AS (SELECT event_id, device_id, account_id, epoch_us(ts) AS t FROM auth),
c AS (SELECT x.*, (SELECT COUNT(DISTINCT y.account_id) FROM a y
                   WHERE y.device_id = x.device_id AND y.t BETWEEN x.t - {DAY_US // 2} AND x.t) AS n
      FROM a x),
f AS (SELECT device_id, t FROM c WHERE n >= 3)
SELECT a.event_id, a.device_id, a.account_id FROM a
WHERE EXISTS (SELECT 1 FROM f WHERE f.device_id = a.device_id AND f.t BETWEEN a.t AND a.t + {DAY_US // 2})
"""

SQL["kyc_audit_latest"] = with_views("accounts", "st") + f""",
fa AS (
  SELECT st.address_id, st.account_id, a.customer_name
  FROM st JOIN accounts a ON a.account_id = st.account_id WHERE a.kyc_status = 'CONFIRMED_FRAUD'),
fk AS (
  SELECT {_norm_sql("s.s_name")} AS address_key, COUNT(DISTINCT fa.account_id) AS n_linked_fraud,
         MIN(customer_name) AS fraud_name
  FROM fa JOIN supplier s ON s.s_suppkey = fa.address_id GROUP BY 1),
docs AS (
  SELECT l.doc_id, s.s_name AS extracted_address,
         NOT COALESCE(l.quality <> 0, false) AS is_tampered,
         CASE WHEN NOT COALESCE(l.toxic <> 1, false) THEN 'REJECT_DEEPFAKE_PORTRAIT'
              WHEN NOT COALESCE(l.quality <> 0, false) THEN 'REJECT_FORGED_ID' ELSE 'APPROVE' END AS decision
  FROM labels l LEFT JOIN supplier s ON s.s_suppkey = l.doc_id % 100)
SELECT 'APPLICANT-' || CAST(d.doc_id AS VARCHAR) AS applicant_name, d.extracted_address, d.is_tampered,
       1.0 - CAST(d.doc_id % 40 AS DOUBLE) / 100.0 AS confidence_score, d.decision,
       CASE WHEN COALESCE(fk.n_linked_fraud, 0) > 0
            THEN 'Direct Link to ' || fk.fraud_name || ' via ' || d.extracted_address
            ELSE 'No adverse graph links.' END AS graph_syndicate_link
FROM docs d LEFT JOIN fk ON fk.address_key = {_norm_sql("d.extracted_address")}
ORDER BY d.doc_id DESC LIMIT 5
"""

SQL["investigation_actions"] = with_views("accounts", "ud", "st") + f""",
ring AS ({RING_BODY}),
expo AS ({EXPOSURE_BODY}),
inv AS (SELECT r.account_id AS target, r.customer_name AS linked_fraud_user,
               COALESCE(x.txns, 0) AS txns, x.total_usd
        FROM ring r LEFT JOIN expo x ON x.account_id = r.account_id)
SELECT target, COUNT(*) AS n_links, COUNT(DISTINCT linked_fraud_user) AS n_linked_fraud_users,
       MAX(txns) AS txns, MAX(total_usd) AS total_usd, 'TEMPORARY_CARD_FREEZE' AS action
FROM inv GROUP BY target
"""

SQL["mark_new"] = with_views("txn") + """,
latest AS (SELECT transaction_id FROM txn ORDER BY ts DESC, transaction_id DESC LIMIT 100)
SELECT t.transaction_id, t.account_id, l.transaction_id IS NOT NULL AS is_new
FROM txn t LEFT JOIN latest l ON l.transaction_id = t.transaction_id
"""

SQL["classify_vector"] = SCORED + "SELECT transaction_id, vector, status_code FROM scored"

SQL["risk_level"] = SCORED + "SELECT transaction_id, risk_score, risk_level FROM scored"

SQL["kyc_verdict"] = f"""
SELECT document_uri, decision,
       CASE WHEN decision LIKE '%REJECT%' THEN 'REJECT' ELSE 'APPROVE' END AS kyc_verdict
FROM ({_ASSESS})
"""
