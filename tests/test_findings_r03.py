"""What the findings of round 3 were about: work done once, tasks of bounded size."""

import pytest
from pyspark.sql import functions as F

from ringfence import session
from ringfence.operators import graph as G
from ringfence.operators import ml as ML
from ringfence.operators import segments
from ringfence.plans import registry as R
from ringfence.sources import testdata as td


class Stop(Exception):
    pass


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_window_sums_keep_one_row_a_row(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", None, 7), (None, 1, 1)], "k string, t long, v long")
    out = segments.window_sums(rows, ["k"], "t", {"s": F.col("v")}, -1, 0)
    assert "Generate" not in plan_of(out)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([("a", 1, 5, 5), ("a", 2, 6, 11), ("a", None, 7, 0), (None, 1, 1, None)], key=repr)


def test_points_without_time_count_as_before(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 3), ("a", None), ("b", 9)], "k string, t long")
    points = spark.createDataFrame([("a", None, 5), ("a", 3, 2), ("a", 4, 1)], "k string, t long, n long")
    got = []
    for most in (segments.KEY_ROWS, -1):
        monkeypatch.setattr(segments, "KEY_ROWS", most)
        out = segments.series(rows, ["k"], "t", {"n": (None, None, 0), "near": (F.lit(1).cast("long"), -1, 0)}, points=points)
        got.append((sorted(map(tuple, out.collect()), key=repr), out.dtypes))
    assert got[0] == got[1]


def written_by(monkeypatch, name, query, *args):
    seen = []

    def write(df, what, *more):
        seen.append(what)
        if what == name:
            raise Stop
        return df

    monkeypatch.setattr(R, "materialize", write)
    with pytest.raises(Stop):
        query(*args)
    return seen


def test_features_are_joined_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, 2.0, 0, 0, 1)], "l_orderkey long, l_partkey long, amount double, is_emulator int, is_high_risk int, is_fraud int")
    monkeypatch.setattr(R, "feature_table", lambda *_: rows)
    monkeypatch.setattr(ML, "train_classifier", lambda *_, **__: pytest.fail("features were not written"))
    for query in (R.q_predict, R.q_train_classifier):
        written_by(monkeypatch, "features", query, spark, "")


def test_holds_are_scored_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, 2.0, "ATO", "BLOCKED")], "transaction_id long, account_id long, amount double, vector string, verdict string")
    monkeypatch.setattr(R, "scored", lambda *_: rows)
    monkeypatch.setattr(td, "transactions", lambda *_: rows)
    monkeypatch.setattr(R.IO, "append_conformed", lambda *_: pytest.fail("holds were not written"))
    written_by(monkeypatch, "holds", R.q_stream_holds, spark, "")


@pytest.mark.parametrize("size", [50, 1_000_000])
def test_transfers_are_spread(spark, tmpdir_fresh, monkeypatch, size):
    monkeypatch.setattr(session, "ROWS_A_TASK", size)
    d = tmpdir_fresh
    spark.range(500).selectExpr("id o_orderkey", "id % 40 o_custkey").write.parquet(f"{d}/orders.parquet")
    spark.range(2000).selectExpr("id % 500 l_orderkey", "id % 30 l_suppkey", "id % 7 * 1.0d l_extendedprice", "0 l_partkey",
                                 "timestamp_ntz'2024-01-01' l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    t = td.transfers(spark, d)
    parts = t.groupBy(F.spark_partition_id().alias("p")).count().collect()
    want = {(i % 500, i % 500 % 40, i % 30, i % 7 * 1.0) for i in range(2000) if i % 500 % 40 != i % 30}
    assert {tuple(r)[:4] for r in t.collect()} == want and sum(r["count"] for r in parts) == len(want)
    if size == 50:
        assert len(parts) > 30 and max(r["count"] for r in parts) < 200
    accounts = spark.range(40).selectExpr("id account_id", "cast(id as string) customer_name",
                                          "if(id < 3, 'VICTIM_COMPROMISED', 'ACTIVE') kyc_status")
    paths = G.transfer_paths(G.FraudGraph(accounts, None, None, None, None, t), 1, 3).collect()
    edges = {}
    for _, a, b, _ in want:
        edges[a, b] = edges.get((a, b), 0) + 1
    walks, front = {}, {(o, o): 1 for o in range(3)}
    for h in (1, 2, 3):
        nxt = {}
        for (o, n), c in front.items():
            for (a, b), k in edges.items():
                if a == n:
                    nxt[o, b] = nxt.get((o, b), 0) + c * k
        front = nxt
        walks.update({(o, n, h): c for (o, n), c in front.items()})
    assert {(r.origin, r.destination, r.hop_count): r.n_paths for r in paths} == walks
