"""Live scoring with takeovers, replays, holds, keyed state and device members."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringfence import schemas
from ringfence.operators import graph as G
from ringfence.operators import scoring as SCR
from ringfence.operators import triage as TR
from ringfence.sources import io as IO
from ringfence.streaming import streams as ST
from ringfence.streaming.keyed_state import KeyedState

T0 = dt.datetime(2026, 1, 1)
HOUR = 3_600_000_000


def _txn(i, account, minutes, amount=20.0, lat=10.0, lon=10.0, bin6="411111"):
    return (f"t{i}", account, amount, "cat", f"d{i % 3}", None, None, T0 + dt.timedelta(minutes=minutes), "POS",
            lat, lon, bin6, None, None)


def _land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _score(spark, base, params, **kw):
    q = ST.score_stream(IO.read_txn_stream(spark, f"{base}/txn"), f"{base}/out", f"{base}/ck", params=params, state_buckets=4,
                        auth=IO.read_auth_stream(spark, f"{base}/auth"), **kw)
    q.awaitTermination()
    assert q.exception() is None


def test_late_fan_in_marks_rows_scored_before(spark, tmpdir_fresh):
    """Three accounts on one device make a fan-in; its last event comes a batch
    later than the transactions that it marks."""
    base, p = tmpdir_fresh, SCR.ScoringParams(ato_window_us=HOUR, ato_hold_us=HOUR)
    auth = [(f"e{i}", f"a{i}", "dev", None, "PASSWORD_RESET", T0 + dt.timedelta(minutes=10 * i)) for i in range(3)]
    other = [("e9", "a5", "dev2", None, "PASSWORD_RESET", T0)]
    first = [_txn(0, "a0", 5), _txn(1, "a1", 15), _txn(2, "a5", 16), _txn(3, "a0", 300)]
    second = [_txn(4, "a2", 25), _txn(5, None, 26), _txn(6, "a1", 400)]
    _land(spark, first, schemas.LIVE_TRANSACTIONS, f"{base}/txn")
    _land(spark, auth[:2] + other, schemas.AUTH_EVENTS, f"{base}/auth")
    _score(spark, base, p)
    before = ST.current_scores(spark, f"{base}/out")
    assert before.count() == 4 and before.filter("is_ato").count() == 0
    _land(spark, second, schemas.LIVE_TRANSACTIONS, f"{base}/txn")
    _land(spark, auth[2:], schemas.AUTH_EVENTS, f"{base}/auth")
    _score(spark, base, p)
    cols = ["transaction_id", "is_ato", "verdict", "vector"]
    got = sorted(map(tuple, ST.current_scores(spark, f"{base}/out").select(cols).collect()))
    batch = SCR.score_batch(spark, spark.createDataFrame(first + second, schemas.LIVE_TRANSACTIONS), None, p,
                            auth=spark.createDataFrame(auth + other, schemas.AUTH_EVENTS))
    assert got == sorted(map(tuple, batch.select(cols).collect()))
    assert [r[0] for r in got if r[1]] == ["t0", "t1", "t4"]
    # only the marked rows of the first batch were written again
    again = spark.read.parquet(f"{base}/out").filter("batch_id > landed_batch")
    assert sorted(r.transaction_id for r in again.collect()) == ["t0", "t1"]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_history_beyond_the_lookback(spark, tmpdir_fresh, order):
    """The newest located swipe and the newest activity lie further back than
    the lookback; batches may come out of time order."""
    base, day = tmpdir_fresh, 24 * 60
    p = SCR.ScoringParams(dormant_gap_us=2 * 24 * HOUR, dormant_min_amount=5.0)
    parts = [[_txn(0, "a", 0, lat=0.0, lon=0.0), _txn(1, "a", 60, lat=None, lon=None)],
             [_txn(2, "a", 50 * day, lat=50.0, lon=50.0)],
             [_txn(3, "a", 50 * day + 30, lat=-50.0, lon=-50.0)]]
    rows = {}
    for i in order:
        _land(spark, parts[i], schemas.LIVE_TRANSACTIONS, f"{base}/txn")
        q = ST.score_stream(IO.read_txn_stream(spark, f"{base}/txn"), f"{base}/out", f"{base}/ck", params=p, lookback="10 days", state_buckets=4)
        q.awaitTermination()
        assert q.exception() is None
    for r in ST.current_scores(spark, f"{base}/out").collect():
        rows[r.transaction_id] = r
    assert len(rows) == 4 and rows["t2"].is_dormant_bust_out
    assert 0 < rows["t2"].calculated_speed_kmh < 100 and not rows["t2"].is_impossible_travel
    if order == (0, 1, 2):
        assert rows["t3"].is_impossible_travel and not rows["t3"].is_dormant_bust_out


def test_replays_of_a_later_run_are_dropped_and_null_ids_kept(spark, tmpdir_fresh):
    base = tmpdir_fresh
    rows = [_txn(i, "a", i) for i in range(20)]
    nameless = [(None, *_txn(0, "b", 19)[1:]), (None, *_txn(0, "b", 19)[1:])]
    for part in (rows + nameless, rows):
        _land(spark, part, schemas.LIVE_TRANSACTIONS, f"{base}/in")
        out = ST.run_to_table(spark, ST.dedupe_replays(IO.read_txn_stream(spark, f"{base}/in"), watermark="1 hour"),
                              f"{base}/out", f"{base}/ck")
    got = [r.transaction_id for r in out.collect()]
    assert len(got) == 22 and got.count(None) == 2 and len(set(got)) == 21


def test_live_holds_equal_batch(spark, tmpdir_fresh):
    """Replies in time decide, the larger code on ties; a reply after the
    answer time counts no more and unanswered holds come out as PENDING."""
    base = tmpdir_fresh
    at = [T0 + dt.timedelta(hours=h) for h in range(40)]
    holds = [("h1", "a", 1.0, "X", at[0]), ("h2", "a", 2.0, "X", at[1]), ("h3", "b", 3.0, "X", at[2]), ("h4", "b", 4.0, "X", at[3])]
    replies = [("h1", "1", at[3]), ("h1", "2", at[3]), ("h2", "2", at[4]), ("h2", "1", at[5]), ("h4", "1", at[39])]
    _land(spark, holds, schemas.HOLDS, f"{base}/h")
    _land(spark, replies, schemas.CARDHOLDER_REPLIES, f"{base}/r")
    h = ST.with_sentinel(IO.read_stream(spark, f"{base}/h", schemas.HOLDS), f"{base}/sh", "held_at", hold_id="end")
    r = ST.with_sentinel(IO.read_stream(spark, f"{base}/r", schemas.CARDHOLDER_REPLIES), f"{base}/sr", "replied_at", hold_id="end")
    out = ST.run_to_table(spark, ST.resolve_holds_stream(h, r, "24 hours", "1 hour"), f"{base}/out", f"{base}/ck")
    got = sorted((x.hold_id, x.status) for x in out.collect())
    in_time = spark.createDataFrame(replies[:4], schemas.CARDHOLDER_REPLIES)
    batch = TR.resolve_holds(spark.createDataFrame(holds, schemas.HOLDS), in_time)
    assert got == sorted((x.hold_id, x.status) for x in batch.collect())
    assert [s for _, s in got] == ["BLOCKED_PERMANENT", "RELEASED", "PENDING", "PENDING"]


def test_keyed_state_rewrites_touched_buckets_only(spark, tmpdir_fresh):
    state = KeyedState(spark, tmpdir_fresh, "k", buckets=16)

    def batch(i, keys):
        rows = spark.createDataFrame([(k, i) for k in keys], "k string, v int")
        touched = state.touched(rows)
        old = state.read(i, touched)
        both = rows if old is None else old.unionByName(rows)
        state.write(i, both.groupBy("k").agg(F.max("v").alias("v")), touched)
        return touched

    batch(0, [f"k{i}" for i in range(100)] + [None])
    batch(1, [])
    touched = batch(2, ["k7", "new"])
    batch(2, ["k7", "new"])  # a batch that runs again finds the same state
    assert len(touched) <= 2 and sorted(b for b, v in state.versions(2).items() if v == 2) == touched
    batch(3, ["k8"])
    everything = {r.k: r.v for r in state.read(4, list(range(16))).collect()}
    assert len(everything) == 102 and everything["k7"] == 2 and everything["new"] == 2 and everything["k8"] == 3
    assert sum(v for v in everything.values()) == 7 and None in everything


def test_members_of_a_hub_come_in_pages(spark):
    links = [(f"a{i}", "hub", "login", T0) for i in range(500)] * 2 + [("a1", "small", "login", T0), (None, "small", "login", T0)]
    g = G.FraudGraph(accounts=spark.createDataFrame([], schemas.ACCOUNTS),
                     devices=spark.createDataFrame([("hub", "x", True), ("small", "x", False)], schemas.DEVICES),
                     addresses=spark.createDataFrame([], schemas.ADDRESSES),
                     used_device=spark.createDataFrame(links, schemas.USED_DEVICE),
                     shipped_to=spark.createDataFrame([], schemas.SHIPPED_TO),
                     transferred=spark.createDataFrame([], schemas.TRANSFERS))
    pages = G.blast_radius_members(g, emulator_only=False, page_size=50).collect()
    hub = [r for r in pages if r.device_id == "hub"]
    assert len(hub) == 10 == hub[0].n_pages and max(len(r.members) for r in hub) < 100
    assert sorted(a for r in hub for a in r.members) == sorted(f"a{i}" for i in range(500))
    assert [r.members for r in pages if r.device_id == "small"] == [["a1"]]
    assert {r.device_id for r in G.blast_radius_members(g, page_size=50).collect()} == {"hub"}
