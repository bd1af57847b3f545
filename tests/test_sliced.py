"""Sliced windows equal plain per-key windows, brute-forced in pandas.

The data has a hot key holding most rows, exact timestamp ties, gaps far
larger than the slice width (empty slices) and slice widths both smaller
and larger than the frames.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringfence.operators.sliced import range_sums, sliced_next, sliced_prev, trailing_distinct


def make_data(seed: int, n: int = 400):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    t = np.sort(rng.integers(0, 5_000, n)) * 1000  # ties on purpose
    t[rng.random(n) < 0.1] += 10_000_000  # a far cluster: empty slices in between
    member = rng.integers(0, 6, n)
    v = rng.integers(1, 100, n)
    return pd.DataFrame({"id": np.arange(n), "k": key, "t": t, "m": member, "v": v})


def brute_prev(pdf):
    s = pdf.sort_values(["k", "t", "id"])
    s["prev_id"] = s.groupby("k")["id"].shift(1)
    s["next_id"] = s.groupby("k")["id"].shift(-1)
    return s.set_index("id")


def brute_range(pdf, lo, hi):
    out = {}
    for k, g in pdf.groupby("k"):
        tt, vv = g["t"].to_numpy(), g["v"].to_numpy()
        for i, t in zip(g["id"], tt):
            sel = (tt >= t + lo) & (tt <= t + hi)
            out[i] = (int(sel.sum()), int(vv[sel].sum()))
    return out


def brute_distinct(pdf, w):
    out = {}
    for k, g in pdf.groupby("k"):
        tt, mm = g["t"].to_numpy(), g["m"].to_numpy()
        for i, t in zip(g["id"], tt):
            out[i] = len(set(mm[(tt >= t - w) & (tt <= t)]))
    return out


@pytest.mark.parametrize("seed,width", [(1, 50_000), (2, 1_000_000), (3, 7_000), (4, 100_000_000)])
def test_prev_next(spark, seed, width):
    pdf = make_data(seed)
    df = spark.createDataFrame(pdf)
    p = sliced_prev(df, ["k"], "t", "id", ["v"], width)
    p = sliced_next(p, ["k"], "t", "id", ["v"], width)
    got = {r.id: (r.prev_id, r.next_id) for r in p.collect()}
    want = brute_prev(pdf)
    for i, row in want.iterrows():
        exp = (None if pd.isna(row.prev_id) else int(row.prev_id),
               None if pd.isna(row.next_id) else int(row.next_id))
        assert got[i] == exp, (i, got[i], exp)


@pytest.mark.parametrize("seed,width,lo,hi", [
    (5, 50_000, -200_000, -1), (6, 1_000_000, -30_000, 0), (7, 3_000, -1_000_000, 5_000),
    (8, 10_000_000, -5_000, -5_000)])
def test_range_sums(spark, seed, width, lo, hi):
    pdf = make_data(seed)
    df = spark.createDataFrame(pdf)
    out = range_sums(df, ["k"], "t", "id", {"n": F.lit(1).cast("long"), "s": F.col("v")}, lo, hi, width)
    got = {r.id: (r.n or 0, r.s or 0) for r in out.collect()}
    want = brute_range(pdf, lo, hi)
    assert got == want


@pytest.mark.parametrize("seed,width,w", [(9, 20_000, 100_000), (10, 1_000_000, 40_000), (11, 5_000, 0)])
def test_trailing_distinct(spark, seed, width, w):
    pdf = make_data(seed)
    df = spark.createDataFrame(pdf)
    out = trailing_distinct(df, ["k"], "m", "t", "id", w, width)
    got = {r.id: r.n_distinct for r in out.collect()}
    assert got == brute_distinct(pdf, w)


def test_auto_width_splits_dense_key(spark):
    from ringfence.operators.sliced import auto_width

    pdf = make_data(12, 2000)
    df = spark.createDataFrame(pdf)
    w = auto_width(df, ["k"], "t", target_rows=100, base=1_000_000_000)
    assert w < 1_000_000_000
    p = sliced_prev(df, ["k"], "t", "id", ["v"], "auto")
    want = brute_prev(pdf)
    got = {r.id: r.prev_id for r in p.collect()}
    assert all(got[i] == (None if pd.isna(row.prev_id) else int(row.prev_id)) for i, row in want.iterrows())
