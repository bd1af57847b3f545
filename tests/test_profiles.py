"""R5's running profile equals a fresh one after every micro-batch."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ringfence.streaming import profiles as PR

D0 = dt.datetime(2026, 3, 1, 12)
SCHEMA = "transaction_id string, account_id string, amount double, timestamp timestamp"


def _brute(known, batch, days, factor):
    out = []
    for i, a, x, t in batch:
        if a is None or t is None or x is None:
            continue
        seen = [r for r in known if r[1] == a and r[3] is not None and 1 <= (t.date() - r[3].date()).days <= days]
        total = sum((Decimal(str(r[2])) for r in seen if r[2] is not None), Decimal(0))
        if seen and any(r[2] is not None for r in seen) and Decimal(str(x)) * len(seen) >= Decimal(str(factor)) * total:
            out.append((i, len(seen), total))
    return out


def test_running_profile_equals_a_fresh_one(spark, tmpdir_fresh):
    rnd, base, known, want, late = random.Random(3), tmpdir_fresh, [], [], []
    newest, held = None, []
    for b in range(5):
        batch = []
        for k in range(60):
            a = "hot" if k % 3 == 0 else rnd.choice("abcd")
            t = D0 + dt.timedelta(days=4 * b + rnd.randrange(4) - (rnd.choice([0, 0, 2, 9]) if b else 0))
            batch.append((f"{b}-{k}", a, float(rnd.choice([1, 2, 3, 5, 40])), t))
        batch += [(f"{b}-x", None, 5.0, D0), (f"{b}-y", "a", 5.0, None), (f"{b}-z", "b", None, D0 + dt.timedelta(days=4 * b))]
        batch += batch[:1]  # a repeated row counts twice
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        q = PR.spike_profile_stream(stream, f"{base}/state", f"{base}/ck", days=6, factor=3.0, late_days=3, state_buckets=4)
        q.awaitTermination()
        assert q.exception() is None
        fine = [r for r in batch if r[3] is None or newest is None or (newest - r[3].date()).days <= 3]
        late += [r[0] for r in batch if r not in fine and r[1] is not None]
        known += fine
        want += _brute(known, fine, 6, 3.0)
        newest = max([r[3].date() for r in fine if r[3] is not None] + ([newest] if newest else []))
        day = newest + dt.timedelta(days=1)
        fresh = {}
        for _, a, x, t in known:
            if a is not None and t is not None and 1 <= (day - t.date()).days <= 6:
                n, total = fresh.get(a, (0, None))
                fresh[a] = (n + 1, total if x is None else (total or Decimal(0)) + Decimal(str(x)))
        got = PR.current_profiles(spark, f"{base}/state", F.lit(day), 6).collect()
        assert {r.account_id: (r.baseline_n, r.baseline_total) for r in got} == fresh
        held.append(PR.KeyedState(spark, f"{base}/state/daily", "account_id").newest().count())
    out = spark.read.parquet(f"{base}/state/out").collect()
    assert sorted((r.transaction_id, r.baseline_n, r.baseline_total) for r in out) == sorted(want) and want
    assert sorted(r.transaction_id for r in spark.read.parquet(f"{base}/state/late").collect()) == sorted(late) and late
    assert held[-1] <= 5 * (4 + 6 + 3 + 4)  # days are retired: no more than the window, the lateness and a batch


def test_running_profile_of_an_empty_stream(spark, tmpdir_fresh):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmpdir_fresh}/in")
    PR.spike_profile_stream(stream, f"{tmpdir_fresh}/state", f"{tmpdir_fresh}/ck", state_buckets=4).awaitTermination()
    assert PR.current_profiles(spark, f"{tmpdir_fresh}/state", F.lit(D0.date())).count() == 0
