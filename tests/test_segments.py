"""Ordered scans equal brute force: hot keys, one-second bursts, replays, null
ids and keys; by plain windows and by sorted ranges alike."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ringfence.operators import detectors as DT
from ringfence.operators import scoring, segments, triage

T0 = datetime(2024, 1, 1)


@pytest.fixture(params=["plain", "ranges"])
def way(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(segments, "KEY_ROWS", -1)
    return request.param


def rows_of(seed, n=500):
    """60 % of the rows are of one key in one second; ids repeat, keys may be null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.6
        out.append((r.randrange(n // 2) if r.random() < 0.9 else None, "hot" if hot else r.choice(["a", "b", None]),
                    7_000_000 + r.randrange(1_000_000) // 250_000 * 250_000 if hot else r.randrange(20) * 1_000_000, r.choice("uvwx"), r.randint(1, 9)))
    return out + out[:20]


SCHEMA = "id long, k string, t long, m string, v long"


def as_set(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("low,high", [(-3_000_000, 0), (-2_000_000, -1), (0, 4_000_000), (250_000, 250_000)])
def test_window_sums(spark, way, low, high):
    rows = rows_of(low + 11)
    got = segments.window_sums(spark.createDataFrame(rows, SCHEMA).repartition(6), ["k"], "t",
                               {"n": F.lit(1).cast("long"), "s": F.col("v").cast("decimal(18,2)")}, low, high).collect()
    want = []
    for x in rows:
        near = [y[4] for y in rows if x[1] is not None and y[1] == x[1] and x[2] + low <= y[2] <= x[2] + high]
        want.append((*x, len(near), sum(near)) if x[1] is not None else (*x, None, None))
    assert as_set((*y[:5], y.n, None if y.s is None else int(y.s)) for y in got) == as_set(want)


def test_series_of_one_sort(spark, way):
    """Sums over rows and over other points, and the latest row by two conditions."""
    rows = [(i, *x[1:]) for i, x in enumerate(rows_of(5))]
    points = [("hot", 7_250_000, 5), ("hot", 6_000_000, 1), ("a", 0, 2), (None, 3, 7), ("a", 0, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = segments.series(df, ["k"], "t", {"n": (F.lit(1).cast("long"), -1_000_000, 0), "e": (None, -10_000_000, 0), "all_e": (None, None, -1)},
                          {"big": (F.col("v") > 7, ["id", "t"]), "any": (F.lit(True), ["id"])},
                          points=spark.createDataFrame(points, "k string, t long, e long").withColumn("all_e", F.col("e")), order=["id"]).collect()
    for y in got:
        if y.k is None:
            assert y.n is None and y.e is None and y.big is None
            continue
        before = sorted((x[2], x[0], x[4]) for x in rows if x[1] == y.k and (x[2], x[0]) < (y.t, y.id))
        big = [b for b in before if b[2] > 7]
        assert (y.any.id if y.any else None) == (before[-1][1] if before else None)
        assert (tuple(y.big) if y.big else None) == ((big[-1][1], big[-1][0]) if big else None)
        assert y.n == sum(x[1] == y.k and y.t - 1_000_000 <= x[2] <= y.t for x in rows)
        assert y.e == sum(p[2] for p in points if p[0] == y.k and y.t - 10_000_000 <= p[1] <= y.t)
        assert y.all_e == sum(p[2] for p in points if p[0] == y.k and p[1] < y.t)
    assert len(got) == len(rows)


@pytest.mark.parametrize("window", [0, 1_500_000])
def test_window_distinct(spark, way, window):
    rows = rows_of(9)
    got = segments.window_distinct(spark.createDataFrame(rows, SCHEMA).repartition(6), ["k"], "m", "t", window).collect()
    want = [(*x, len({y[3] for y in rows if y[1] == x[1] and x[2] - window <= y[2] <= x[2]}) if x[1] is not None else None) for x in rows]
    assert as_set(got) == as_set(want)


def test_hot_second_is_cut_into_ranges(spark, monkeypatch):
    """All rows of one key and one instant: no range holds much more than its share."""
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(5).cast("long").alias("t"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        placed = segments._sorted(df, ["k"], ["t"], "test-segments")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000


def txn(i, account="A", amount=1.0, seconds=0, bin_="4111", lat=None, lon=None, device="d1"):
    return (i, account, float(amount), "shop", device, T0 + timedelta(seconds=seconds), lat, lon, bin_)


TXN = ("transaction_id string, account_id string, amount double, merchant_category string, device_id string, timestamp timestamp, "
       "latitude double, longitude double, card_bin string")


def test_replays_and_null_ids_count_as_rows(spark, way):
    rows = [txn("x", seconds=1), txn("x", seconds=1), txn(None, seconds=2)]
    got = DT.bin_velocity_rows(spark.createDataFrame(rows, TXN), min_count=1).collect()
    assert sorted(r.n_attempts for r in got) == [2, 2, 3]
    blocks = spark.createDataFrame([("d1", T0)], "device_id string, blocked_at timestamp")
    out = triage.screen_blocklist(spark.createDataFrame(rows, TXN), blocks, "device_id").collect()
    assert [(r.n_active_blocks, r.is_blocked) for r in out] == [(1, True)] * 3
    auth = spark.createDataFrame([("e", "d", a, T0) for a in "ABB"] + [(None, "d", "C", T0)], "event_id string, device_id string, account_id string, timestamp timestamp")
    assert [r.n_accounts for r in DT.ato_fan_in_rows(auth, min_accounts=3).collect()] == [3] * 4
    spent = DT.spend_baseline(spark.createDataFrame([txn("y", amount=5), txn("y", amount=5), txn(None, amount=7, seconds=9)], TXN)).collect()
    assert sorted((r.baseline_n, float(r.baseline_total)) for r in spent) == [(0, 0.0), (0, 0.0), (2, 10.0)]


def test_scores_do_not_depend_on_row_order(spark, way):
    rows = [txn("x", seconds=0, bin_="4111"), txn("x", seconds=0, bin_="5222"), txn("y", seconds=1, bin_="4111"), txn("z", seconds=2, bin_="4111"),
            txn(None, seconds=3, bin_="5222"), txn("w", account=None, seconds=4)]
    p = scoring.ScoringParams()
    seen = set()
    for seed in range(3):
        some = list(rows)
        random.Random(seed).shuffle(some)
        df = spark.createDataFrame(some, TXN).coalesce(1)
        out = scoring.score_batch(spark, df, p=p).collect()
        assert len(out) == len(rows)
        seen.add(tuple(sorted((str(r.transaction_id), r.verdict, r.vector, r.is_bin_attack) for r in out)))
    assert len(seen) == 1


def test_replies_at_one_time(spark):
    holds = spark.createDataFrame([("h", "A", 5.0)], "hold_id string, account_id string, amount double")
    for order in ("12", "21"):
        replies = spark.createDataFrame([("h", c, T0) for c in order], "hold_id string, reply string, replied_at timestamp").coalesce(1)
        assert triage.resolve_holds(holds, replies).first().status == "BLOCKED_PERMANENT"


def test_latency_of_replays(spark):
    raw = spark.createDataFrame([("x", T0), ("x", T0), ("y", T0)], "transaction_id string, timestamp timestamp")
    scored = spark.createDataFrame([(i, T0 + timedelta(seconds=2)) for i in "xxy"], "transaction_id string, processed_at timestamp")
    row = triage.decision_latency(raw, scored).first()
    assert (row.n, row.total_latency_us, row.max_latency_us) == (2, 4_000_000, 2_000_000)


def test_subnet_blocks_of_replays(spark):
    actions = spark.createDataFrame([("x", triage.SUBNET_ACTION)] * 2, "transaction_id string, action string")
    scored = spark.createDataFrame([("x", T0), ("x", T0 + timedelta(seconds=1))], "transaction_id string, processed_at timestamp")
    txns = spark.createDataFrame([("x", "10.1.2.3"), ("x", "10.1.2.3")], "transaction_id string, ip_address string")
    assert triage.subnet_blocks(actions, scored, txns).count() == 1
