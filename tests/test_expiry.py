"""Blocks that expire by event-time timers leave the state and the table."""

import datetime as dt

from pyspark.sql import functions as F

from ringfence.streaming import streams as ST

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "device_id string, blocked_at timestamp"


def _hours(h):
    return T0 + dt.timedelta(hours=h)


def _run(spark, base, rows, **kw):
    """One more file, one more run from the same checkpoint."""
    spark.createDataFrame([(d, None if h is None else _hours(h)) for d, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{base}/in")
    q = ST.blocklist_stream(stream, "device_id", f"{base}/out", f"{base}/ck", watermark="1 hour", state_buckets=4, **kw)
    q.awaitTermination()
    assert q.exception() is None
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    table = {r.device_id: r.expires_at for r in ST.live_blocklist(spark, f"{base}/out", "device_id").collect()}
    return table, rows[-1] if rows else None


def test_expired_blocks_leave_state_and_table(spark, tmpdir_fresh):
    table, state = _run(spark, tmpdir_fresh, [("d1", 0), ("d2", 0), ("d1", 0), (None, 0), ("d9", None)])
    assert table == {"d1": _hours(24), "d2": _hours(24)}
    # d1 is blocked again, and an older block of it comes late; both stay
    table, _ = _run(spark, tmpdir_fresh, [("d1", 20), ("d1", 3), ("d3", 5)])
    assert table == {"d1": _hours(44), "d2": _hours(24), "d3": _hours(29)}
    # the watermark (25 h 30) passes d2's expiry, not yet d3's; a late block that is still active counts, one expired doesn't
    table, state = _run(spark, tmpdir_fresh, [("d4", 26.5)])
    assert table == {"d1": _hours(44), "d3": _hours(29), "d4": _hours(50.5)}
    table, held = _run(spark, tmpdir_fresh, [("d5", 10), ("d6", 0.5)])
    assert table == {"d1": _hours(44), "d3": _hours(29), "d4": _hours(50.5), "d5": _hours(34)}
    # all is over but the newest; what is left in the state is one block and its timer
    table, state = _run(spark, tmpdir_fresh, [("d7", 200)])
    assert table == {"d7": _hours(224)} and state < held
    as_of = F.lit(_hours(300)).cast("timestamp")
    assert ST.live_blocklist(spark, f"{tmpdir_fresh}/out", "device_id", as_of).count() == 0
    assert ST.live_blocklist(spark, f"{tmpdir_fresh}/out", "device_id", as_of).columns == ["device_id", "last_blocked_at", "expires_at"]


def test_blocklist_without_rows_is_empty(spark, tmpdir_fresh):
    table, _ = _run(spark, tmpdir_fresh, [])
    assert table == {}
