"""Row numbers within groups, without a task that holds a group.

Rows are sorted into ranges of (group, order), and a row's number is its place
in its own range plus the rows of its group in the ranges before. Only one row
per range and group meets in a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

_RANGE_BITS = 33  # of monotonically_increasing_id: the place in a range


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "numbered") -> DataFrame:
    """``rows`` with pos (from 0, by ``order``) and n (rows of the group), both
    long. Rows equal in ``order`` are numbered as they come. The group columns
    must not be null."""
    keys = [*group, *order]
    placed = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", _RANGE_BITS))
    runs = placed.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    one = Window.partitionBy(*group)
    runs = runs.select("_range", *group, (F.coalesce(F.sum("_rows").over(one.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                                          - F.col("_first")).alias("_shift"), F.sum("_rows").over(one).alias("n"))
    return (placed.join(runs, ["_range", *group])
            .select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n"))


def sorted_groups(batches, *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows come sorted by ``keys`` (not null): each run of equal keys as one table."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in columns)
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
