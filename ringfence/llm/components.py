"""Connected components of an edge list by alternating large and small stars.

Every step is a grouped minimum and an equi-join, written once; a hub node's
neighbours are folded map-side and its join rows may be split by AQE. Up to
``ONE_TASK`` edges (counted first) need no shuffle: one task joins them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, staged

ONE_TASK = 1 << 20


def _joined(batches):
    """(node, label) of all edges that the task reads."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for lo in range(0, len(nodes), 1 << 16):
        some = nodes[lo:lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "label"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node of their star. ``edges``: (u, v), u > v."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        low = low.withColumn("m", F.least("u", "m"))
        kept = edges.filter("v > u")
    else:
        kept = edges.unionByName(edges.select("u", F.col("u").alias("v")).distinct())
    return (kept.join(low, "u").filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label): label is the smallest node reachable; only nodes that have an edge."""
    now = staged(edges.filter(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")), "edges")
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_joined, "node long, label long")
    mark = None
    while True:
        step = staged(_star(_star(now.distinct(), True), False), "stars")
        drop_staged(now)
        now, before = step, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
    own = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(own).select(F.col("u").alias("node"), F.col("v").alias("label"))
