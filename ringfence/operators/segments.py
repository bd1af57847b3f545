"""Ordered scans of keyed rows that no key can overload.

A grouped count of the keys comes first. While the largest key has at most
``KEY_ROWS`` rows a plain window by key does. Beyond that rows are sorted by (keys, order, row) into ranges of about equal size, so a key
with a third of all rows, or with all of them in one second, is cut into as
many ranges as its rows need. A scan is then a fold within each range plus one
carry row per range and key from the ranges before. Results come with the row
itself: nothing is joined back on an id, so repeated and null ids are rows like
all others.

* ``series`` gives each row sums over windows of its key and the latest earlier
  row that meets a condition, any number of both from one sort. By plain windows
  a sum is a difference of running totals; in ranges a row becomes
  one mark at its own time, which carries it, and one query for each end of a
  window; in the sorted order a query's running total is the sum of all points
  before its time. The marks of a row meet again by its row number.
* ``previous``, ``window_sums`` and ``window_distinct`` are its common cases.

Sorted ranges are written once: a lost executor reads them again, and the
rows' numbers stay the same. A row with a null key belongs to no series: it has
no row before it, and its sums are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

KEY_ROWS = 2_000_000  # of one key, that a task may sort by itself
_RANGE_BITS = 33      # of monotonically_increasing_id: the place in a range


def _keyed(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Written: ``rows`` with __at, their place in the order, and __range."""
    by = [*keys, *order]
    placed = (rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by, "__row")
              .sortWithinPartitions(*by, "__row").drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    return materialize(placed, name).withColumn("__range", F.shiftright("__at", _RANGE_BITS))


def largest(rows: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key."""
    return rows.filter(_keyed(keys)).groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _scan(placed: DataFrame, keys: Sequence[str], fold: dict[str, Column], join: dict) -> DataFrame:
    """Adds, by name, ``fold`` over the rows of the key before each row.
    ``join[name]``: the aggregate of a range, how to fold aggregates of earlier
    ranges, and how to join both parts."""
    inside = Window.partitionBy("__range", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy("__range", *keys).agg(*(join[n][0].alias(f"__c_{n}") for n in fold))
    carry = carry.select("__range", *keys, *(join[n][1](f"__c_{n}").over(before).alias(f"__b_{n}") for n in fold))
    rows = placed.select("*", *(c.over(inside).alias(f"__i_{n}") for n, c in fold.items()))
    rows = rows.join(carry, ["__range", *keys])
    return rows.select(*placed.columns, *(join[n][2](F.col(f"__i_{n}"), F.col(f"__b_{n}")).alias(n) for n in fold))


def _unkeyed(rows: DataFrame, keys: Sequence[str], out: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows without a key, with nulls for the ``names`` of ``out``."""
    kinds = dict(out.dtypes)
    return rows.filter(~_keyed(keys)).select("*", *(F.lit(None).cast(kinds[n]).alias(n) for n in names))


def _windowed(rows: DataFrame, keys: Sequence[str], t: str, sums: dict, latest: dict, points: DataFrame | None,
              order: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """``series`` of the rows with a key by windows: a sum is the difference of
    two running totals, so a row is sorted once and stays one row."""
    by = [f"__k{i}" for i in range(len(keys))]
    own = rows.filter(_keyed(keys)).select(
        "*", *(F.col(k).alias(b) for k, b in zip(keys, by)), F.col(t).alias("__time"), F.lit(True).alias("__mine"),
        *((F.lit(None).cast(kinds[n]) if v is None else v).alias(f"__v_{n}") for n, (v, _, _) in sums.items()))
    d = own
    if points is not None:
        d = own.unionByName(points.filter(_keyed(keys)).select(
            *(F.col(k).alias(b) for k, b in zip(keys, by)), F.col("t").alias("__time"),
            *(F.col(n).alias(f"__v_{n}") for n in sums if n in points.columns)), allowMissingColumns=True)
    total = dict(d.agg(*(F.sum(f"__v_{n}").alias(n) for n in sums)).agg(*(F.sum(n).alias(n) for n in sums)).dtypes)
    before = Window.partitionBy(*by).orderBy("__time", *order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *(F.last(F.when(F.col("__mine") & when, F.struct(*columns)), ignorenulls=True).over(before).alias(f"__l_{n}")
                        for n, (when, columns) in latest.items()))
    timed = Window.partitionBy(*by).orderBy("__time")

    def upto(n, b):
        none = F.lit(0).cast(total[n])
        run = F.sum(f"__v_{n}").over(timed.rangeBetween(Window.unboundedPreceding, b)).cast(total[n])
        return F.when(F.col("__time").isNull(), none).otherwise(F.coalesce(run, none))

    d = d.select("*", *(upto(n, high).alias(f"__u_{n}") for n, (_, _, high) in sums.items()),
                 *(upto(n, low - 1).alias(f"__d_{n}") for n, (_, low, _) in sums.items() if low is not None))
    return d.filter("__mine").select(
        *rows.columns, *(F.col(f"__l_{n}").alias(n) for n in latest),
        *((F.col(f"__u_{n}") if low is None else F.col(f"__u_{n}") - F.col(f"__d_{n}")).alias(n) for n, (_, low, _) in sums.items()))


def series(rows: DataFrame, keys: Sequence[str], t: str, sums: dict[str, tuple[Column | None, int | None, int]] | None = None,
           latest: dict[str, tuple[Column, Sequence[str]]] | None = None, points: DataFrame | None = None,
           order: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """``rows`` with, by name (``most``: rows of the largest key with its
    points, an upper bound; counted if it is not given):

    ``sums``: (value, lower, upper): the sum of ``value`` over the rows of the
    same keys with time in [t + lower, t + upper] (micros, inclusive; without
    lower: up to t + upper). ``points`` (keys, t and some of the names) are
    summed besides; a value of None sums these alone.
    ``latest``: (condition, columns): a struct of the columns of the last
    earlier row that meets it; rows of one time come by ``order``."""
    sums, latest = sums or {}, latest or {}
    if most is None:
        most = largest(rows, keys) + (largest(points, keys) if points is not None else 0)
    small = most * (1 + 2 * len(sums)) <= KEY_ROWS
    if small and not sums:
        plain = Window.partitionBy(*keys).orderBy(t, *order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *(F.when(_keyed(keys), F.last(F.when(when, F.struct(*columns)), ignorenulls=True).over(plain)).alias(n)
                                  for n, (when, columns) in latest.items()))
    kinds = dict(rows.select(*(v.alias(n) for n, (v, _, _) in sums.items() if v is not None)).dtypes)
    kinds.update({} if points is None else {n: k for n, k in points.dtypes if n in sums})
    if small:
        out = _windowed(rows, keys, t, sums, latest, points, order, kinds)
        return out.unionByName(_unkeyed(rows, keys, out, (*latest, *sums)))
    bounds = sorted({b for _, low, high in sums.values() for b in (low, high + 1) if b is not None})
    own, tie = F.struct(*rows.columns), F.struct(F.lit(0).alias("o"), *order)
    seen = {n: F.when(when, F.struct(*columns)) for n, (when, columns) in latest.items()}
    types = dict(rows.select(own.alias("__own"), tie.alias("__tie"), *(c.alias(f"__v_{n}") for n, c in seen.items())).dtypes)

    def mark(at, bound):
        mine = bound is None
        carried = {"__own": own, "__tie": tie, **{f"__v_{n}": c for n, c in seen.items()}}
        return F.struct(at.alias("__t"), F.lit(bound).cast("long").alias("__bound"),
                        *((c if mine else F.lit(None).cast(types[n])).alias(n) for n, c in carried.items()),
                        *((v if mine and v is not None else F.lit(None).cast(kinds[n])).alias(n) for n, (v, _, _) in sums.items()))

    marks = (rows.filter(_keyed(keys)).withColumn("__id", F.monotonically_increasing_id())
             .select(*keys, "__id", F.explode(F.array(mark(F.col(t), None), *(mark(F.col(t) + F.lit(b), b) for b in bounds))).alias("__m"))
             .select(*keys, "__id", "__m.*"))
    if points is not None:
        marks = marks.unionByName(points.filter(_keyed(keys)).withColumnRenamed("t", "__t"), allowMissingColumns=True)
    # at one instant queries come first: a query counts what lies before its time
    marks, by = marks.withColumn("__point", F.col("__bound").isNull()), ["__t", "__point", "__tie"]
    folds = {f"__s_{n}": F.sum(n) for n in sums} | {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True) for n in latest}
    carries = {f"__s_{n}": (F.sum(n), F.sum, lambda i, b: F.coalesce(i + b, i, b)) for n in sums}
    carries |= {f"__l_{n}": (F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("__at"))),
                             lambda c: F.last(c, ignorenulls=True), F.coalesce) for n in latest}
    out = _scan(_sorted(marks, keys, by, "segments"), keys, folds, carries)
    if not sums:
        out = out.filter("__own is not null").select("__own.*", *(F.col(f"__l_{n}").alias(n) for n in latest))
    else:
        mine = F.col("__own").isNotNull()

        def at(n, b):
            return F.sum(F.when(F.col("__bound") == b, F.col(f"__s_{n}")))

        ends = [at(n, high + 1).alias(f"__u_{n}") for n, (_, _, high) in sums.items()] + [at(n, low).alias(f"__d_{n}") for n, (_, low, _) in sums.items() if low is not None]
        one = out.filter("__id is not null").groupBy("__id").agg(
            F.first("__own", ignorenulls=True).alias("__own"), *(F.first(F.when(mine, F.col(f"__l_{n}")), ignorenulls=True).alias(n) for n in latest), *ends)

        def total(n, low):
            up, none = F.col(f"__u_{n}"), F.lit(0).cast(dict(one.dtypes)[f"__u_{n}"])
            return (F.coalesce(up, none) if low is None else F.coalesce(up, none) - F.coalesce(f"__d_{n}", none)).alias(n)

        out = one.select("__own.*", *latest, *(total(n, low) for n, (_, low, _) in sums.items()))
    return out.unionByName(_unkeyed(rows, keys, out, (*latest, *sums)))


def previous(rows: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], columns: Sequence[str], prefix: str = "prev_",
             most: int | None = None) -> DataFrame:
    """``rows`` with ``prev_<column>`` of the row before, by ``t`` and ``order`` within ``keys``."""
    out = series(rows, keys, t, latest={"__near": (F.lit(True), columns)}, order=order, most=most)
    return out.select(*rows.columns, *(F.col(f"__near.{c}").alias(prefix + c) for c in columns))


def window_sums(rows: DataFrame, keys: Sequence[str], t: str, values: dict[str, Column], lower: int, upper: int,
                points: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``rows`` with the sums of ``values`` over the rows of the same keys with
    time in [t + lower, t + upper]. ``points`` (keys, t, value names) is summed
    instead of ``rows`` if given."""
    if lower > upper:
        raise ValueError("lower must be <= upper")
    return series(rows, keys, t, {n: (c if points is None else None, lower, upper) for n, c in values.items()}, points=points, most=most)


def window_distinct(rows: DataFrame, keys: Sequence[str], member: str, t: str, window: int, out: str = "n_distinct",
                    most: int | None = None) -> DataFrame:
    """``rows`` with the distinct ``member`` values of the same keys in
    [t - window, t]. A member counts from each of its rows to its next one, or to
    the end of the window, so a count is a sum of starts and ends."""
    most = largest(rows, keys) if most is None else most
    known = rows.select(*keys, member, F.col(t).alias("t"), (-F.col(t)).alias("__back")).filter(_keyed([*keys, member]))
    ends = previous(known, [*keys, member], "__back", (), ["t"], prefix="__n_", most=most)
    end = F.least(F.col("t") + F.lit(window + 1), F.coalesce("__n_t", F.col("t") + F.lit(window + 1)))
    points = ends.select(*keys, F.explode(F.array(
        F.struct(F.col("t").alias("t"), F.lit(1).cast("long").alias(out)),
        F.struct(end.alias("t"), F.lit(-1).cast("long").alias(out)))).alias("p")).select(*keys, "p.*")
    return series(rows, keys, t, {out: (None, None, 0)}, points=points, most=3 * most)
