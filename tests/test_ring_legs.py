"""The ring by its lighter leg against all pairs, with a hub device and a hub address."""

import random

import pytest
from pyspark.sql import functions as F

from ringfence.operators import graph as G


def _graph(spark, used, shipped, accounts, n_nodes, device_type="string"):
    return G.FraudGraph(
        accounts=spark.createDataFrame([(a, f"name {a}", G.CONFIRMED_FRAUD if a.startswith("f") else "OK") for a in accounts],
                                       "account_id string, customer_name string, kyc_status string"),
        devices=spark.createDataFrame([(n, "x", False) for n in range(n_nodes)], "device_id long, device_type string, is_emulator boolean")
        .withColumn("device_id", F.col("device_id").cast(device_type)),
        addresses=spark.createDataFrame([(n, f"street {n}", False) for n in range(n_nodes)], "address_id long, full_address string, is_commercial_drop boolean"),
        used_device=spark.createDataFrame(used, "account_id string, device_id long").withColumn("device_id", F.col("device_id").cast(device_type)),
        shipped_to=spark.createDataFrame(shipped, "account_id string, address_id long"))


def _brute(used, shipped, accounts, n_nodes, distinct, targets=None):
    known = set(accounts)
    out = []
    for f in accounts:
        if not f.startswith("f"):
            continue
        for a1, d in used:
            if a1 != f or d is None or d >= n_nodes:
                continue
            for s, d2 in used:
                if d2 != d or s not in known or (distinct and s == f) or (targets is not None and s not in targets):
                    continue
                mine = [h for a, h in shipped if a == f and h is not None and h < n_nodes]
                theirs = [h for a, h in shipped if a == s]
                out += [(s, d, f, h) for h in mine for h2 in theirs if h == h2]
    return sorted(out)


@pytest.mark.parametrize("device_type", ["bigint", "string"])
def test_ring_legs_with_hubs(spark, device_type):
    rnd = random.Random(7)
    accounts = [f"f{i}" for i in range(6)] + [f"a{i}" for i in range(80)]
    used = {(a, 0) for a in accounts if a not in ("f3", "f4", "f5")}    # device 0 is a hub
    shipped = {(a, 1) for a in accounts if a not in ("f0", "f1", "f5")}  # address 1 is a hub
    for a in accounts:
        used |= {(a, rnd.randrange(2, 14)) for _ in range(2)}
        shipped |= {(a, rnd.randrange(2, 14)) for _ in range(2)}
    used |= {("ghost", 0), ("a1", 50), ("f1", 50), ("f1", None)}  # no such account, no such device, no device
    shipped |= {("ghost", 1), (None, 3)}
    used, shipped = sorted(used, key=str), sorted(shipped, key=str)
    for distinct in (True, False):
        g = _graph(spark, used, shipped, accounts, 14, device_type)
        got = G.ring_matches(g, G.fraud_seeds(g), distinct)
        assert dict(got.dtypes)["device_id"] == device_type and dict(got.dtypes)["address_id"] == "bigint"
        rows = sorted((r.suspicious_id, int(r.device_id), r.fraud_id, r.address_id) for r in got.collect())
        assert rows == _brute(used, shipped, accounts, 14, distinct) and rows
    g = _graph(spark, used, shipped, accounts, 14, device_type)
    wanted = spark.createDataFrame([("a1",), ("a2",), ("a2",), ("nobody",)], "suspicious_id string")
    rows = sorted((r.suspicious_id, int(r.device_id), r.fraud_id, r.address_id) for r in G.ring_matches(g, G.fraud_seeds(g), False, wanted).collect())
    assert rows == _brute(used, shipped, accounts, 14, False, {"a1", "a2"})


def test_a_hub_is_not_expanded_where_there_is_a_smaller_way(spark):
    accounts = ["f0", "f1"] + [f"a{i}" for i in range(300)]
    used = [(a, 0) for a in accounts] + [("f0", 1), ("a5", 1)]           # every account has device 0
    shipped = [("f0", 2), ("a5", 2), ("a6", 2), ("f1", 3), ("a7", 3)] + [("a8", 4)]
    g = _graph(spark, used, shipped, accounts, 10)
    first, second = G.ring_legs(g, G.fraud_seeds(g), True)
    assert first.count() + second.count() < 12  # the hub alone has 600 pairs with the two
    assert {r.kind for r in first.collect()} == {"A"}
    got = sorted((r.suspicious_id, r.device_id, r.fraud_id) for r in G.ring_matches(g, G.fraud_seeds(g), True).collect())
    assert got == [("a5", "0", "f0"), ("a5", "1", "f0"), ("a6", "0", "f0"), ("a7", "0", "f1")]


def test_ring_without_edges_or_seeds_is_empty(spark):
    g = _graph(spark, [("a1", 1)], [("a1", 1)], ["a1"], 3)
    assert G.ring_matches(g, G.fraud_seeds(g), True).count() == 0
    g = _graph(spark, [("f1", 1), ("a1", 1)], [], ["a1", "f1"], 3)
    assert G.ring_matches(g, G.fraud_seeds(g), True).count() == 0
