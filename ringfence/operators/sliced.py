"""Skew-safe ordered windows.

A plain ``Window.partitionBy(account)`` sends every row of an account to one
task; one account holding a third of the data then means one task holding a
third of the data. The helpers here split each key by time slices of width
``width`` (micros) and stitch the slices back together exactly:

* ``sliced_prev`` / ``sliced_next``: lag/lead within (key, slice), and for the
  first (last) row of a slice the boundary row of the nearest earlier (later)
  non-empty slice, taken from a one-row-per-slice summary.
* ``sliced_prefix``: P(x) = sum of point values with t < x, for arbitrary
  query points. Per (key, slice) range window for the in-slice part, plus the
  cumulative total of all earlier slices from the summary.
* NULL keys: a row with a NULL key belongs to no series; it has no neighbour
  and its sums are NULL, whatever the slice width.
* ``range_sums``: frame sums over [t + lower, t + upper] as
  P(t + upper + 1) - P(t + lower).

Every window runs on (key, slice) groups; the summary has one row per
non-empty (key, slice), so a hot key costs at most (time span / width) rows
in the only per-key window. Shuffles: the points/queries once on
(key, slice), the query results once on row id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
DEFAULT_WIDTH_US = DAY_US


def epoch_us(c: Column | str) -> Column:
    """Epoch micros of a timestamp or timestamp_ntz column (session zone UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def auto_width(df: DataFrame, keys: Sequence[str], t: str, target_rows: int = 2_000_000,
               base: int = DEFAULT_WIDTH_US, floor_us: int = 1_000_000) -> int:
    """Slice width so the densest (key, slice) group holds about
    ``target_rows`` rows, measured again at each width (bursts are not even):
    grouped counts, combined map-side, and one scalar each to the driver.
    Widths are powers-of-two fractions of ``base``, never below ``floor_us``.
    The width changes the plan only, never the result."""
    densest = (df.groupBy(*keys, F.floor(F.col(t) / F.lit(base)).alias("__d")).count()
               .agg(F.max("count")).first()[0] or 0)
    width = base
    while densest > target_rows and width // 2 >= floor_us:
        width //= 2
        densest = (df.groupBy(*keys, F.floor(F.col(t) / F.lit(width)).alias("__d")).count()
                   .agg(F.max("count")).first()[0] or 0)
    return width


def _resolve_width(df: DataFrame, keys: Sequence[str], t: str, width) -> int:
    return auto_width(df, keys, t) if width == "auto" else int(width)


def _slice(t: str, width: int) -> Column:
    return F.floor(F.col(t) / F.lit(width)).cast("long")


def _keyed(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _neighbour(df: DataFrame, keys: Sequence[str], t: str, tie: str,
               cols: Sequence[str], width, prefix: str, forward: bool) -> DataFrame:
    width = _resolve_width(df, keys, t, width)
    sl = "__slice"
    rec = F.struct(F.col(t).alias("t"), F.col(tie).alias("tie"), *[F.col(c).alias(c) for c in cols])
    d = df.withColumn(sl, _slice(t, width)).withColumn("__rec", rec)
    w_in = Window.partitionBy(*keys, sl).orderBy(t, tie)
    near = F.lead("__rec").over(w_in) if forward else F.lag("__rec").over(w_in)
    d = d.withColumn("__near", near)
    # One row per non-empty (key, slice): its first and last record. A grouped
    # aggregate, so each task combines its rows map-side before the (small)
    # shuffle; a hot key contributes one row per slice per task.
    summ = d.groupBy(*keys, sl).agg(F.min("__rec").alias("__first"), F.max("__rec").alias("__last"))
    w_sl = Window.partitionBy(*keys).orderBy(sl)
    edge = F.lead("__first").over(w_sl) if forward else F.lag("__last").over(w_sl)
    summ = summ.select(*keys, sl, edge.alias("__edge"))
    d = d.join(summ, [*keys, sl], "left")
    d = d.withColumn("__near", F.when(_keyed(keys), F.coalesce(F.col("__near"), F.col("__edge"))))
    out_cols = [F.col("__near.t").alias(f"{prefix}{t}"), F.col("__near.tie").alias(f"{prefix}{tie}")]
    out_cols += [F.col(f"__near.{c}").alias(f"{prefix}{c}") for c in cols]
    return d.select(*df.columns, *out_cols)


def sliced_prev(df: DataFrame, keys: Sequence[str], t: str, tie: str,
                cols: Sequence[str] = (), width: int = DEFAULT_WIDTH_US,
                prefix: str = "prev_") -> DataFrame:
    """lag over (keys) ordered by (t, tie) -> ``prev_<t>``, ``prev_<tie>``,
    ``prev_<col>``. ``t`` is epoch micros; (t, tie) must be unique per key.
    ``width`` is the slice width in micros, or "auto" (see ``auto_width``)."""
    return _neighbour(df, keys, t, tie, cols, width, prefix, forward=False)


def sliced_next(df: DataFrame, keys: Sequence[str], t: str, tie: str,
                cols: Sequence[str] = (), width: int = DEFAULT_WIDTH_US,
                prefix: str = "next_") -> DataFrame:
    """lead over (keys) ordered by (t, tie); see ``sliced_prev``."""
    return _neighbour(df, keys, t, tie, cols, width, prefix, forward=True)


def sliced_prefix(points: DataFrame, queries: DataFrame, keys: Sequence[str],
                  values: Sequence[str], width: int = DEFAULT_WIDTH_US) -> DataFrame:
    """For each query row (keys, t, qid, sign): sign * sum of point values with
    the same keys and point t < query t, one column per name in ``values``.

    ``points`` has (keys, t, values...). Returns (qid, sign, values...).
    """
    width = _resolve_width(points, keys, "t", width)
    sl = "__slice"
    vnames = [f"__v{i}" for i in range(len(values))]
    qid_type = dict(queries.dtypes)["qid"]
    p = points.select(*keys, F.col("t").alias("__t"),
                      *[F.col(v).alias(n) for v, n in zip(values, vnames)],
                      F.lit(None).cast(qid_type).alias("__qid"), F.lit(0).alias("__sign"))
    zero_types = dict(p.dtypes)
    q = queries.select(*keys, F.col("t").alias("__t"),
                       *[F.lit(0).cast(zero_types[n]).alias(n) for n in vnames],
                       F.col("qid").alias("__qid"), F.col("sign").cast("int").alias("__sign"))
    e0 = p.unionByName(q).filter(_keyed(keys)).withColumn(sl, _slice("__t", width))
    w_before = Window.partitionBy(*keys, sl).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    e = e0.select(*keys, sl, "__qid", "__sign",
                  *[F.sum(n).over(w_before).alias(f"{n}_in") for n in vnames])
    # Slice totals (a grouped sum: combined map-side, so the shuffle carries
    # one row per (key, slice) per task; query rows add 0 but make their
    # slices exist), then the running total of all earlier slices per key.
    summ = e0.groupBy(*keys, sl).agg(*[F.sum(n).alias(f"{n}_tot") for n in vnames])
    w_key = Window.partitionBy(*keys).orderBy(sl).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, sl, *[F.sum(f"{n}_tot").over(w_key).alias(f"{n}_before") for n in vnames])
    qs = e.filter(F.col("__qid").isNotNull()).join(summ, [*keys, sl], "inner")
    total = [
        (F.col("__sign") * (F.coalesce(F.col(f"{n}_before"), F.lit(0))
                            + F.coalesce(F.col(f"{n}_in"), F.lit(0)))).alias(v)
        for n, v in zip(vnames, values)
    ]
    return qs.select(F.col("__qid").alias("qid"), F.col("__sign").alias("sign"), *total)


def range_sums(df: DataFrame, keys: Sequence[str], t: str, row_id: str,
               values: dict[str, Column], lower: int, upper: int,
               width: int = DEFAULT_WIDTH_US, points: DataFrame | None = None) -> DataFrame:
    """Adds, for every row of ``df``, the sums of ``values`` over the rows of
    the same keys with point time in [t + lower, t + upper] (micros, both
    inclusive). ``t`` is epoch micros, ``row_id`` unique. ``points`` (keys,
    t, value names) replaces ``df`` as the set being summed when given.
    """
    if lower > upper:
        raise ValueError("lower must be <= upper")
    width = _resolve_width(df, keys, t, width)
    names = list(values)
    if points is None:
        points = df.select(*keys, F.col(t).alias("t"), *[c.alias(n) for n, c in values.items()])
    bounds = F.array(
        F.struct((F.col(t) + F.lit(upper + 1)).alias("t"), F.lit(1).alias("sign")),
        F.struct((F.col(t) + F.lit(lower)).alias("t"), F.lit(-1).alias("sign")),
    )
    queries = (df.select(*keys, F.col(row_id).alias("qid"), F.explode(bounds).alias("b"))
               .select(*keys, "qid", F.col("b.t").alias("t"), F.col("b.sign").alias("sign")))
    pref = sliced_prefix(points, queries, keys, names, width)
    sums = pref.groupBy("qid").agg(*[F.sum(n).alias(n) for n in names])
    return df.join(sums.withColumnRenamed("qid", row_id), row_id, "left")


def trailing_distinct(df: DataFrame, keys: Sequence[str], member: str, t: str,
                      row_id: str, window: int, width: int = DEFAULT_WIDTH_US,
                      out: str = "n_distinct") -> DataFrame:
    """Distinct ``member`` values per keys among rows with time in [t - window, t].

    Each event of a member starts an interval [t_e, min(t_e + window + 1,
    next event of the same member)) during which that member is counted;
    intervals of one member are disjoint, so the distinct count at time t
    is (#starts <= t) - (#ends <= t): a prefix sum, computed sliced.
    No set of members is ever collected.
    """
    width = _resolve_width(df, keys, t, width)
    nxt = sliced_next(df.select(*keys, member, t, row_id), [*keys, member], t, row_id,
                      width=width, prefix="__n_")
    end = F.least(F.col(t) + F.lit(window + 1),
                  F.coalesce(F.col(f"__n_{t}"), F.col(t) + F.lit(window + 1)))
    pts = nxt.select(*keys, F.explode(F.array(
        F.struct(F.col(t).alias("t"), F.lit(1).alias("d")),
        F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("p")
    ).select(*keys, F.col("p.t").alias("t"), F.col("p.d").cast("long").alias("d"))
    queries = df.select(*keys, F.col(row_id).alias("qid"), (F.col(t) + 1).alias("t"),
                        F.lit(1).alias("sign"))
    pref = sliced_prefix(pts, queries, keys, ["d"], width)
    return df.join(pref.select(F.col("qid").alias(row_id), F.col("d").alias(out)), row_id, "left")
