"""The driver's bound on bins works on the histogram of lengths."""

import numpy as np

from ringfence.llm import packing


def test_bound_of_a_histogram():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = r.integers(1, 100, r.integers(0, 60))
        w, n = np.unique(x, return_counts=True)
        order = r.permutation(len(w))
        assert packing.lower_bound(w[order], 100, n[order]) == packing.lower_bound(x, 100)
    assert packing.lower_bound(np.array([600, 7]), 1024, np.array([10**12, 10**12])) == 10**12  # never one number an item


def test_pack_gives_the_driver_one_number_a_length(spark, monkeypatch):
    seen, bound = [], packing.lower_bound
    monkeypatch.setattr(packing, "lower_bound", lambda lengths, *a: seen.append(len(lengths)) or bound(lengths, *a))
    df = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "id % 3 + 1 AS length", "7L AS ids_crc32")
    assert packing.pack(df, size=100).count() == 500
    assert seen == [3]
