"""Ordered work without a single-task window.

A window partitioned only by a key puts a hot key into one task, and a window without a key
puts the whole table there.  Everything ordered in this package goes through *slices* instead:
the order is cut at approximate quantiles of all rows, so a (key, slice) pair holds at most about
``rows / slices`` rows however skewed the keys are; a value of the first column with more rows than
that is cut along the second.  Totals per (key, slice) are tiny
and give each slice its starting value; the rest is a window inside the slice.

The cut points are a small list fixed on the driver, hence the slice of a row is a function of the
row alone and a recomputed task lands on the same slice.  No checkpoint is needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.session import materialize, shuffled, small_side

ROWS_PER_TASK = 4_000_000


# ---------------------------------------------------------------- helpers


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the left keys are kept.  Without keys ``right`` is one row of totals, or the query fails."""
    if not keys:
        counted = right.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
        one = counted.filter(F.assert_true(F.col("_rows") <= 1, "the side without keys has several rows").isNull()).drop("_rows")
        return left.crossJoin(F.broadcast(one))
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def _ordered(df: DataFrame, col: str) -> Column:
    """``col`` as something that points can be compared with: text as it is, all else as a double."""
    dt, c = df.schema[col].dataType, F.col(col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    return c if isinstance(dt, T.StringType) else c.cast("double")


def slice_count(df: DataFrame) -> int:
    """Four slices for each shuffle partition: what a cluster is set to shuffle in, it can also sort in."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def cut_points(df: DataFrame, col: str, slices: int) -> list:
    """``slices - 1`` ascending points near the quantiles of all rows; a value with many rows comes several times.

    Numbers use Spark's quantile sketch, text the quantiles of a random sample of about fifty rows for each slice.
    """
    if slices < 2:
        return []
    x = _ordered(df, col)
    if not isinstance(df.schema[col].dataType, T.StringType):
        probs = [i / slices for i in range(1, slices)]
        return df.agg(F.percentile_approx(F.nullif(x, F.lit(float("nan"))), probs, 10 * slices)).first()[0] or []
    rows = df.select(x.alias("x")).filter("x is not null")
    n = rows.count()
    some = rows if n <= 50 * slices else rows.sample(50 * slices / n, seed=7)
    found = [r.x for r in some.orderBy("x").collect()]
    return [found[i * len(found) // slices] for i in range(1, slices)] if found else []


def _passed(points: list, x: Column) -> Column:
    """How many of the ascending ``points`` are at or below ``x``, by a scan of every k-th and one between two of them; NULL passes none."""
    if not points:
        return F.lit(0)
    k = math.isqrt(len(points)) + 1
    chunks = [points[i : i + k] for i in range(0, len(points), k)]
    at = F.size(F.filter(F.array(*[F.lit(c[0]) for c in chunks[1:]]), lambda q: q <= x)) if len(chunks) > 1 else F.lit(0)
    near = F.array(*[F.array(*[F.lit(q) for q in c]) for c in chunks])[at]
    return at * k + F.size(F.filter(near, lambda q: q <= x))


def slicer(df: DataFrame, order: Sequence[str], slices: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Cuts ``df`` along ``order``: a function that adds ``_slice`` to tables with these columns.

    Slices follow the first column.  A value, NULL too, that would fill three slices or more is cut along the second column,
    within its rows; what ties in both stays together.  NULL is in the first slices and NaN in the last, where sorting puts them.
    """
    slices, first = slices or slice_count(df), order[0]
    points = cut_points(df, first, slices)
    x = _ordered(df, first)
    unique = sorted(set(points))
    heavy = {v: points.count(v) for v in unique if points.count(v) >= 3} if len(order) > 1 and len(unique) < len(points) else {}
    inner: dict = {}
    if len(order) > 1:
        n = df.agg(F.count(F.lit(1)), F.count(first)).first()
        if n[0] and slices * (n[0] - n[1]) // n[0] >= 3:
            inner[None] = sorted(set(cut_points(df.filter(F.col(first).isNull()), order[1], slices * (n[0] - n[1]) // n[0])))
        for v, m in heavy.items():
            inner[v] = sorted(set(cut_points(df.filter(x == F.lit(v)), order[1], m)))

    def add(t: DataFrame) -> DataFrame:
        x = _ordered(t, first)
        nan = F.isnan(x) if not isinstance(t.schema[first].dataType, T.StringType) else F.lit(False)
        place = F.when(x.isNull(), 0).when(nan, len(unique)).otherwise(_passed(unique, x))
        ahead = F.lit(0)  # slices that were put in before
        own = F.lit(0)
        for v, pts in inner.items():
            second = _ordered(t, order[1])
            here = x.isNull() if v is None else (x == F.lit(v))
            later = x.isNotNull() if v is None else (~nan & (x > F.lit(v))) | nan
            own = F.when(here, _passed(pts, second) + (F.isnan(second).cast("int") if not isinstance(t.schema[order[1]].dataType, T.StringType) else 0)).otherwise(own)
            ahead = ahead + F.when(later, len(pts) + 2).otherwise(0)
        return t.withColumn("_slice", place + ahead + F.coalesce(own, F.lit(0)))

    return add


def _earlier(by: Sequence[str], descending: bool):
    key = F.desc("_k._slice") if descending else F.asc("_k._slice")
    return Window.partitionBy(*[F.col(f"_k.`{c}`") for c in by]).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)


def _within(order: Sequence):
    return Window.partitionBy("_k").orderBy(*order)


def _keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Key and slice as one struct ``_k``.  Structs with equal NULL fields are equal, so a plain join on
    ``_k`` is null-safe and shares its partitioning with the window over ``_k``: one shuffle serves both."""
    return df.withColumn("_k", F.struct(*by, "_slice")).drop("_slice")


def directed(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in cols]


def even_keys(df: DataFrame, by: Sequence[str], slices: int | None = None) -> int:
    """The number of rows if no ``by`` group, NULL keys among them, has more rows than a slice would, else 0 (partial counts, two numbers back).

    With many such keys nearly every row has a (key, slice) pair of its own, so slices cost as much as the rows; a window over the key alone gives no task more.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("rows")).first()
    return sizes.rows if sizes.rows and sizes.top * (slices or slice_count(df)) <= sizes.rows else 0


# ---------------------------------------------------------------- prefix sums


def prefix_sum(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    slices: int | None = None,
    even: int | bool = False,
) -> DataFrame:
    """One row per (``by``, ``order`` value) with its total and the running total of each sum.

    Ties share one row.  Columns: ``by``, ``order``, then ``<name>`` and ``cum_<name>`` (inclusive).  ``even`` says that :func:`even_keys` holds.
    """
    by = list(by)
    if even:
        w = Window.partitionBy(*by).orderBy(*directed([order], descending)).rowsBetween(Window.unboundedPreceding, 0)
        own = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        return own.select(*by, order, *sums, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"cum_{n}") for n in sums])
    cut = slicer(df, [order], slices)
    own = df.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    own = _keyed(cut(own), by)
    per_slice = own.groupBy("_k").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    before = per_slice.select(
        "_k", *[F.coalesce(F.sum(f"_t_{n}").over(_earlier(by, descending)), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    w = _within(directed([order], descending)).rowsBetween(Window.unboundedPreceding, 0)
    return own.join(shuffled(before) if by else before, "_k").select(
        *by, order, *sums, *[(F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(w), F.lit(0))).alias(f"cum_{n}") for n in sums]
    )


def row_positions(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    descending: bool = False,
    slices: int | None = None,
    even: int | bool = False,
) -> DataFrame:
    """1-based row number per ``by`` (or over the whole table), split by slices along ``order``, or by ``by`` alone where :func:`even_keys` holds (``even``)."""
    by, order = list(by), list(order)
    if even:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*directed(order, descending))))
    cut = _keyed(slicer(df, order, slices)(df), by)
    per_slice = cut.groupBy("_k").agg(F.count(F.lit(1)).alias("_n_here"))
    before = per_slice.select("_k", F.coalesce(F.sum("_n_here").over(_earlier(by, descending)), F.lit(0)).alias("_before"))
    w = _within(directed(order, descending))
    return cut.join(before, "_k").withColumn(name, F.col("_before") + F.row_number().over(w)).drop("_k", "_before")


def ranks(
    df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, slices: int | None = None
) -> DataFrame:
    """Adds ``rank_min``, ``rank_avg``, ``rank_max`` and ``rank_dense`` of ``value`` within ``by``.

    Ranks come from running counts over distinct values, which are then joined back.
    """
    by = list(by)
    pre = prefix_sum(
        df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rn")),
        value,
        {"_rc": F.col("_rn"), "_rd": F.lit(1)},
        by,
        descending,
        slices,
    )
    table = pre.select(
        *by,
        value,
        (F.col("cum__rc") - F.col("_rc") + 1).alias("rank_min"),
        (F.col("cum__rc") - (F.col("_rc") - 1) / 2).alias("rank_avg"),
        F.col("cum__rc").alias("rank_max"),
        F.col("cum__rd").alias("rank_dense"),
    )
    return null_safe_join(df, table, [*by, value])


def carry_last(
    df: DataFrame,
    order: Sequence[str],
    values: Sequence[str],
    by: Sequence[str] = (),
    forward: bool = False,
    slices: int | None = None,
    even: int | bool = False,
) -> DataFrame:
    """Adds ``last_<v>``: the last non-NULL ``v`` at or before the row (at or after if ``forward``).  ``even`` says that :func:`even_keys` holds."""
    by, order = list(by), list(order)
    if even:
        w = Window.partitionBy(*by).orderBy(*directed(order, forward)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"last_{v}": F.last(v, ignorenulls=True).over(w) for v in values})
    cut = _keyed(slicer(df, order, slices)(df), by)
    rank_key = F.struct(*order)
    pick = F.min_by if forward else F.max_by
    ends = cut.groupBy("_k").agg(
        *[pick(F.col(v), F.when(F.col(v).isNotNull(), rank_key)).alias(f"_e_{v}") for v in values]
    )
    before = ends.select("_k", *[F.last(f"_e_{v}", ignorenulls=True).over(_earlier(by, forward)).alias(f"_b_{v}") for v in values])
    w = _within(directed(order, forward)).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(before, "_k").withColumns(
        {f"last_{v}": F.coalesce(F.last(v, ignorenulls=True).over(w), F.col(f"_b_{v}")) for v in values}
    ).drop("_k", *[f"_b_{v}" for v in values])


# ---------------------------------------------------------------- finite frames


def hot_key(df: DataFrame, by: Sequence[str], limit: int = ROWS_PER_TASK) -> bool:
    """True if some ``by`` group has more than ``limit`` rows (partial counts, one number back)."""
    top = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (top or 0) > limit


def _stages(df: DataFrame, built) -> DataFrame:
    for stage in built if isinstance(built, list) else [built]:
        df = df.withColumns(stage)
    return df


def windowed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    build: Callable[[object], dict[str, Column] | list[dict[str, Column]]],
    lookback: int = 0,
    lookahead: int = 0,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds the window columns of ``build(window)`` whose frames reach at most ``lookback`` rows
    back and ``lookahead`` rows ahead (in all, if ``build`` gives a list of successive stages).

    Groups that fit a task use one plain window.  If some group does not, every group is cut into
    chunks of ``rows_per_task`` rows by exact row position, and the few rows that a neighbouring
    chunk can see are copied to it; copies are dropped afterwards, so the result is the same.
    """
    by, order = list(by), list(order)
    if not hot_key(df, by, rows_per_task):
        return _stages(df, build(Window.partitionBy(*by).orderBy(*order)))
    rows_per_task = max(rows_per_task, lookback, lookahead)  # so a frame sees the neighbouring chunks only
    pos = row_positions(df, order, by, "_pos")
    chunk = F.floor((F.col("_pos") - 1) / rows_per_task)
    offset = (F.col("_pos") - 1) % rows_per_task
    homes = F.filter(
        F.array(
            F.struct(chunk.alias("c"), F.lit(True).alias("own")),
            F.when(offset >= rows_per_task - lookback, F.struct((chunk + 1).alias("c"), F.lit(False).alias("own"))),
            F.when((offset < lookahead) & (chunk > 0), F.struct((chunk - 1).alias("c"), F.lit(False).alias("own"))),
        ),
        lambda h: h.isNotNull(),
    )
    spread = pos.withColumn("_h", F.explode(homes)).withColumns({"_chunk": F.col("_h.c"), "_own": F.col("_h.own")}).drop("_h")
    w = Window.partitionBy(*by, "_chunk").orderBy("_pos")
    return _stages(spread, build(w)).filter("_own").drop("_pos", "_chunk", "_own")


def group_transform(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], few: bool = False) -> DataFrame:
    """Group aggregates on every row: partial aggregation and a join, not a window per key.

    With ``few`` the aggregates are written and counted, and broadcast if they are few, so that no task reads a whole group.
    """
    by = list(by)
    groups = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return null_safe_join(df, small_side(materialize(groups)) if few else groups, by, "left")


# ---------------------------------------------------------------- quantiles and bins


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per ``by`` with ``q0, q1, ...``.

    Ranks come from running counts of distinct values, so no group is buffered in one task.
    """
    by = list(by)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    pre = prefix_sum(
        clean.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_qn")), value, {"_qc": F.col("_qn")}, by, slices=slices
    )
    totals = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("_qtotal"))
    j = null_safe_join(pre, totals, by)
    v, first, last = F.col(value).cast("double"), F.col("cum__qc") - F.col("_qc"), F.col("cum__qc") - 1
    picks = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_qtotal") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        picks += [
            F.max(F.when((first <= lo) & (lo <= last), v)).alias(f"_lo{i}"),
            F.max(F.when((first <= hi) & (hi <= last), v)).alias(f"_hi{i}"),
            F.max(h - lo).alias(f"_f{i}"),
        ]
    out = j.groupBy(*by).agg(*picks)
    return out.select(
        *by,
        *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i in range(len(probs))],
    )


def quantile_list(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    row = quantiles(df, value, probs).first()
    return [] if row is None else list(row)


def bin_right_closed(col: Column, edges: Sequence[float]) -> Column:
    """Bin number 1..n of right-closed intervals, first interval closed on both sides; else NULL."""
    out = F.when((col >= edges[0]) & (col <= edges[1]), 1)
    for i in range(1, len(edges) - 1):
        out = out.when((col > edges[i]) & (col <= edges[i + 1]), i + 1)
    return out


def qcut(df: DataFrame, value: str, q: int, name: str = "bin", duplicates: str = "raise") -> DataFrame:
    """Quantile bins 1..q by interpolated quantile edges (not ``ntile``: equal values stay together)."""
    edges = quantile_list(df, value, [i / q for i in range(q + 1)])
    unique = sorted(set(edges))
    if len(unique) < len(edges):
        if duplicates != "drop":
            raise ValueError("quantile edges are not unique")
        edges = unique
    if len(edges) < 2:
        return df.withColumn(name, F.when(F.col(value).isNotNull(), 1))
    return df.withColumn(name, bin_right_closed(F.col(value), edges))


def cut(df: DataFrame, value: str, bins: int | Sequence[float], name: str = "bin") -> DataFrame:
    """Equal-width bins (left edge lowered by 0.1 % of the range) or explicit right-closed breaks."""
    if not isinstance(bins, int):
        b = list(bins)
        out = F.lit(None).cast("int")
        for i in range(len(b) - 1):
            out = F.when((F.col(value) > b[i]) & (F.col(value) <= b[i + 1]), i + 1).otherwise(out)
        return df.withColumn(name, out)
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    width = (hi - lo) / bins
    edges = [lo + i * width for i in range(bins)] + [hi]
    edges[0] = lo - 0.001 * (hi - lo)
    return df.withColumn(name, bin_right_closed(F.col(value), edges))


def weighted_qcut(df: DataFrame, value: str, weight: str, q: int, name: str = "bin", slices: int | None = None) -> DataFrame:
    """Bins by cumulative weight share in value order; equal values share a bin."""
    pre = prefix_sum(df, value, {"w": F.col(weight)}, slices=slices)
    total = df.agg(F.sum(weight).alias("_total"))
    t = pre.crossJoin(F.broadcast(total)).select(
        value, F.greatest(F.lit(1), F.least(F.lit(q), F.ceil(F.round(F.col("cum_w") / F.col("_total") * q, 9)))).cast("int").alias(name)
    )
    return null_safe_join(df, t, [value], "left")


def weighted_percentile(df: DataFrame, value: str, weight: str, p: float, slices: int | None = None) -> DataFrame:
    """Value at cumulative weight share ``p`` (0..1), linear between neighbouring distinct values."""
    pre = prefix_sum(df, value, {"w": F.col(weight)}, slices=slices)
    total = df.agg(F.sum(weight).alias("_total"))
    share = pre.crossJoin(F.broadcast(total)).select(F.col(value).alias("v"), (F.col("cum_w") / F.col("_total")).alias("s"))
    below, above = F.col("s") <= p, F.col("s") > p
    ends = share.agg(
        F.max(F.when(below, F.struct("s", "v"))).alias("lo"),
        F.min(F.when(above, F.struct("s", "v"))).alias("hi"),
    )
    slope = (F.col("hi.v") - F.col("lo.v")) / F.nullif(F.col("hi.s") - F.col("lo.s"), F.lit(0.0))
    return ends.select(
        F.coalesce(F.col("lo.v") + (p - F.col("lo.s")) * slope, F.col("lo.v"), F.col("hi.v")).alias("value")
    )


# ---------------------------------------------------------------- deterministic shuffling


def hash_order(*cols, seed: int = 0) -> Column:
    """A seeded pseudo-random order that is a function of the row, not of the task."""
    return F.xxhash64(F.lit(seed), *cols)


def hash_unit(*cols, seed: int = 0) -> Column:
    """Seeded uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))
