"""Ordered operators: lags, rolling and running statistics, fills, indicators, recursions.

Finite frames go through :func:`order.windowed` (hot keys are cut into overlapping chunks),
running totals and fills through the sliced primitives of :mod:`order`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.operators.order import (
    ROWS_PER_TASK, carry_last, even_keys, group_transform, hot_key, null_safe_join, prefix_sum, ranks, row_positions, windowed,
)
from tabloom.session import dealt, materialize


def full_frame(agg: Column, w, n: int) -> Column:
    """``agg`` over the last ``n`` rows, NULL until ``n`` rows exist."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) == n, agg.over(frame))


def lag_lead(df: DataFrame, by, order: str, col: str, lags: Sequence[int], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``<col>_lag_n`` for positive and ``<col>_lead_n`` for negative numbers (a lead is a leak in training)."""
    return windowed(
        df, by, [order],
        lambda w: {(f"{col}_lag_{n}" if n > 0 else f"{col}_lead_{-n}"): F.lag(col, n).over(w) for n in lags},
        max([0, *lags]), max([0, *[-n for n in lags]]), rows_per_task,
    )


def rolling(df: DataFrame, by, order: str, col: str, n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rolling mean and sample deviation of the last ``n`` rows."""
    return windowed(
        df, by, [order],
        lambda w: {f"{col}_mean_{n}": full_frame(F.avg(col), w, n), f"{col}_std_{n}": full_frame(F.stddev_samp(col), w, n)},
        n - 1, 0, rows_per_task,
    )


def changes(df: DataFrame, by, order: str, col: str, n: int = 1) -> DataFrame:
    """Difference, relative change, and seconds since the previous row."""
    return windowed(
        df, by, [order],
        lambda w: {
            f"{col}_diff": F.col(col) - F.lag(col, n).over(w),
            f"{col}_pct": F.try_divide(F.col(col), F.lag(col, n).over(w)) - 1,
            "step_seconds": (F.unix_micros(order) - F.unix_micros(F.lag(order, 1).over(w))) / 1e6,
        },
        n,
    )


def array_median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(s)
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, hi).otherwise((F.get(s, (F.floor(n / 2) - 1).cast("int")) + hi) / 2)


def lag_stats(df: DataFrame, by, order: str, col: str, windows: Sequence[int]) -> DataFrame:
    """Per window length: mean, median, min, max and log of the mean of non-zeros, over full windows."""

    def build(w):
        first, second = {}, {}
        for n in windows:
            first |= {
                f"mean_{n}": full_frame(F.avg(col), w, n),
                f"min_{n}": full_frame(F.min(col), w, n),
                f"max_{n}": full_frame(F.max(col), w, n),
                f"ln_nonzero_{n}": F.ln(full_frame(F.avg(F.when(F.col(col) != 0, F.col(col))), w, n)),
                f"_a_{n}": full_frame(F.collect_list(col), w, n),
            }
            second[f"median_{n}"] = array_median(F.col(f"_a_{n}"))
        return [first, second]

    return windowed(df, by, [order], build, max(windows) - 1).drop(*[f"_a_{n}" for n in windows])


def rolling_mode(df: DataFrame, by, order: Sequence[str], value: str, n: int, name: str = "mode", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Most frequent value of the last ``n`` rows, the smallest among equals: one window, no explosion."""
    v = F.col(value)
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        v = F.when(v == 0, F.lit(0).cast(df.schema[value].dataType)).otherwise(v)  # -0.0 is 0.0
    return windowed(df, by, order, lambda w: {name: F.mode(v, deterministic=True).over(w.rowsBetween(-(n - 1), 0))}, n - 1, 0, rows_per_task)


def running(df: DataFrame, by, order: str, col: str) -> DataFrame:
    """Running sum and mean up to each step and, shifted one step, what was known before it."""
    s = prefix_sum(df, order, {"v": F.col(col), "n": F.when(F.col(col).isNotNull(), 1).otherwise(0)}, by)
    prior_n = F.col("cum_n") - F.col("n")
    return s.select(
        *by, order,
        F.col("cum_v").alias("cum_sum"),
        F.try_divide("cum_v", "cum_n").alias("cum_mean"),
        F.try_divide(F.col("cum_v") - F.coalesce("v", F.lit(0.0)), prior_n).alias("prior_mean"),
    )


def dense_rank(df: DataFrame, by, value: str, name: str = "rank") -> DataFrame:
    return ranks(df, value, by).withColumnRenamed("rank_dense", name).drop("rank_min", "rank_avg", "rank_max")


def last_k_items(df: DataFrame, key: Sequence[str], t: str, item: str, k: int = 50, tail: int = 5, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """For each purchase date: the previous distinct (date, item) pairs, newest first, as ``L1..Lk``,
    and the first ``tail`` of them as text.

    A date can add at most ``k`` items to any list, so items are first cut to ``k`` per date (the cut
    runs before the shuffle), then each date looks at the ``k`` dates before it.
    """
    key = list(key)
    w = Window.partitionBy(*key, t).orderBy(item)
    top = df.select(*key, t, item).distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    days = top.groupBy(*key, t).agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def build(win):
        seen = F.collect_list("_items").over(win.rowsBetween(-k, -1))
        return [{"_seen": seen}, {"_prev": F.slice(F.flatten(F.reverse(F.col("_seen"))), 1, k)}]

    out = windowed(days, key, [t], build, k, 0, rows_per_task)
    return out.select(
        *key, t,
        *[F.get("_prev", F.lit(i)).alias(f"L{i + 1}") for i in range(k)],
        F.array_join(F.slice("_prev", 1, tail), " ").alias(f"last_{tail}"),
    )


def history_counts(df: DataFrame, key: Sequence[str], t: str, item: str, values: Sequence) -> DataFrame:
    """Per purchase date, how often each item value occurred on earlier dates.

    Where keys are even, their rows are dealt by key once and counted there, in tasks whose number grows with the rows.
    """
    df = df.select(*key, t, item)
    even = even_keys(df, key)
    if even:
        df = dealt(df, even, *key)
    sums = {f"n_{v}": F.when(F.col(item) == v, 1).otherwise(0) for v in values}
    s = prefix_sum(df, t, sums, key, even=even)
    return s.select(*key, t, *[(F.col(f"cum_{n}") - F.col(n)).alias(n) for n in sums])


def fills(df: DataFrame, by, order: str, col: str) -> DataFrame:
    """Forward fill, back fill and linear interpolation in time."""
    t = F.unix_micros(order).cast("double")
    seen = df.withColumn("_p", F.when(F.col(col).isNotNull(), F.struct(t.alias("t"), F.col(col).alias("v"))))
    out = carry_last(seen, [order], ["_p"], by).withColumnRenamed("last__p", "_b")
    out = carry_last(out, [order], ["_p"], by, forward=True).withColumnRenamed("last__p", "_a")
    slope = F.try_divide(F.col("_a.v") - F.col("_b.v"), F.col("_a.t") - F.col("_b.t"))
    return out.withColumns({
        f"{col}_ffill": F.col("_b.v"),
        f"{col}_bfill": F.col("_a.v"),
        f"{col}_interp": F.coalesce(F.col(col), F.col("_b.v") + slope * (t - F.col("_b.t"))),
    }).drop("_p", "_a", "_b")


def cumcount(df: DataFrame, by, order: Sequence[str]) -> DataFrame:
    """n-th row of its key, number of rows of the key, and an alternating odd/even state."""
    out = group_transform(row_positions(df, order, by, "nth"), by, {"total": F.count(F.lit(1))})
    return out.withColumn("state", F.when(F.col("nth") % 2 == 1, "odd").otherwise("even"))


def tenure(df: DataFrame, key: str, t: str, known: DataFrame | None = None) -> DataFrame:
    """Days since the id was first seen; ``known`` (key, first) holds first dates stored earlier."""
    first = df.groupBy(key).agg(F.min(t).alias("first"))
    if known is not None:
        first = first.unionByName(known.select(key, "first")).groupBy(key).agg(F.min("first").alias("first"))
    return df.join(first, key, "left").withColumn("tenure_days", F.datediff(t, "first"))


def prior_outcomes(df: DataFrame, by, t: str, won: Column) -> DataFrame:
    """Wins on strictly earlier dates: ``times_won_before`` and ``won_before`` per (by, date)."""
    s = prefix_sum(df, t, {"w": won.cast("int")}, by)
    before = F.col("cum_w") - F.col("w")
    return s.select(*by, t, before.alias("times_won_before"), (before > 0).alias("won_before"))


def gap_profile(df: DataFrame, key: str, t: str) -> DataFrame:
    """Per gap length in days: how many gaps; with the share of all gaps and of ids having > 2 lengths."""
    steps = windowed(df.select(key, t).distinct(), [key], [t], lambda w: {"_p": F.lag(t).over(w)}, 1)
    g = steps.filter("_p is not null").groupBy(key, F.datediff(t, "_p").alias("gap")).agg(F.count(F.lit(1)).alias("k"))
    per_gap = g.groupBy("gap").agg(F.sum("k").alias("n"))
    all_gaps = per_gap.agg(F.sum("n").alias("_t"))
    ids = g.groupBy(key).agg(F.count(F.lit(1)).alias("sizes")).agg(F.avg((F.col("sizes") > 2).cast("int")).alias("irregular_share"))
    return per_gap.crossJoin(F.broadcast(all_gaps)).crossJoin(F.broadcast(ids)).select(
        "gap", "n", (F.col("n") / F.col("_t")).alias("share"), "irregular_share"
    )


def win_rate(df: DataFrame, by, item: str, score: str) -> DataFrame:
    """Share of groups an item wins (minimum rank 1), its mean gap to the best; losers stay with 0."""
    best = group_transform(df, by, {"_best": F.max(score), "_n": F.count(F.lit(1))})
    groups = df.select(*by).distinct().agg(F.count(F.lit(1)).alias("_g"))
    out = best.groupBy(item).agg(
        F.count_if(F.col(score) == F.col("_best")).alias("wins"),
        F.avg(F.col("_best") - F.col(score)).alias("mean_gap"),
        F.count(F.lit(1)).alias("entries"),
    )
    return out.crossJoin(F.broadcast(groups)).withColumn("win_rate", F.col("wins") / F.col("_g")).drop("_g")


# ---------------------------------------------------------------- indicators on OHLCV bars


def sum_arr(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def indicators(bars: DataFrame, by: str = "symbol", order: str = "date", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Finite-memory indicators by their published definitions; one row per bar in and out."""
    o, h, l, c, v = [F.col(x) for x in ("open", "high", "low", "close", "volume")]
    tp = (h + l + c) / 3

    def build(w):
        def f(agg, n):
            return full_frame(agg, w, n)

        prev = F.lag("close").over(w)
        clv = F.coalesce(F.try_divide((c - l) - (h - c), h - l), F.lit(0.0))
        base = {"_tp": tp, "clv": clv, "_d": c - prev, "_pc": prev, "_tpd": tp - F.lag(tp).over(w)}
        hh, ll = f(F.max("high"), 14), f(F.min("low"), 14)
        money = F.col("_tp") * v
        up = F.sum(F.when(F.col("_tpd") > 0, money).otherwise(0.0))
        down = F.sum(F.when(F.col("_tpd") < 0, money).otherwise(0.0))
        gain = F.sum(F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0))
        loss = F.sum(F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0))
        have = F.lag("_d", 13).over(w).isNotNull()
        main = {
            "tr": F.greatest(h, F.coalesce("_pc", h)) - F.least(l, F.coalesce("_pc", l)),
            "momentum": F.col("_d"),
            "sma": f(F.avg("close"), 10),
            "_l10": f(F.collect_list("close"), 10),
            "_m20": f(F.avg("_tp"), 20),
            "_s20": f(F.stddev_pop("_tp"), 20),
            "_l20": f(F.collect_list("_tp"), 20),
            "fast_k": F.try_divide(c - ll, hh - ll),
            "wpr": F.try_divide(hh - c, hh - ll),
            "cmo": F.when(have, 100 * F.try_divide(f(gain, 14) - f(loss, 14), f(gain, 14) + f(loss, 14))),
            "mfi": F.when(F.lag("_tpd", 13).over(w).isNotNull(), 100 - 100 / (1 + F.try_divide(f(up, 14), f(down, 14)))),
            "_h21": f(F.collect_list("high"), 21),
            "_w21": f(F.collect_list("low"), 21),
            "vhf": F.when(
                F.lag("_d", 27).over(w).isNotNull(),
                F.try_divide(f(F.max("close"), 28) - f(F.min("close"), 28), f(F.sum(F.abs("_d")), 28)),
            ),
            **{f"cmf_{n}": F.try_divide(f(F.sum(F.col("clv") * v), n), f(F.sum("volume"), n)) for n in range(1, 8)},
        }
        weights = F.sequence(F.lit(1), F.lit(10))
        dev = F.aggregate("_l20", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m20"))) / 20
        age_h = 20 - (21 - F.array_position(F.reverse(F.col("_h21")), F.array_max("_h21")))
        age_l = 20 - (21 - F.array_position(F.reverse(F.col("_w21")), F.array_min("_w21")))
        last = {
            "wma": sum_arr(F.zip_with("_l10", weights, lambda a, b: a * b)) / 55,
            "dpo": c - F.col("sma"),
            "bb_pct": F.try_divide(F.col("_tp") - (F.col("_m20") - 2 * F.col("_s20")), 4 * F.col("_s20")),
            "cci": F.try_divide(F.col("_tp") - F.col("_m20"), 0.015 * dev),
            "aroon_up": 100 * (20 - age_h) / 20,
            "aroon_down": 100 * (20 - age_l) / 20,
        }
        return [base, main, last]

    out = windowed(bars, [by], [order], build, 60, 0, rows_per_task)
    return out.select(by, order, *[c for c in out.columns if not c.startswith("_") and c not in (by, order, "open", "high", "low", "close", "volume")])


def lag_vector_fit(df: DataFrame, by, order: str, col: str, n: int = 14, lags: int = 14, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Differences to 1..``lags`` steps back, a line through the first ``n`` of them, its value at n+1,
    and that value over the sample deviation of all differences.  x is constant, so the fit is closed-form."""

    def build(w):
        diffs = F.array(*[F.col(col) - F.lag(col, k).over(w) for k in range(1, lags + 1)])
        return [{"_d": F.when(F.lag(col, lags).over(w).isNotNull(), diffs)}]

    d = windowed(df, by, [order], build, lags, 0, rows_per_task)
    xbar = (n + 1) / 2
    sxx = n * (n * n - 1) / 12
    head = F.slice("_d", 1, n)
    ybar = sum_arr(head) / n
    slope = sum_arr(F.zip_with(head, F.sequence(F.lit(1), F.lit(n)), lambda y, x: y * (x - xbar))) / sxx
    mean = sum_arr(F.col("_d")) / lags
    sd = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean)) / (lags - 1))
    return (
        d.withColumns({"slope": slope, "sd": sd, "_y": ybar})
        .withColumn("intercept", F.col("_y") - F.col("slope") * xbar)
        .withColumn("pred", F.col("intercept") + F.col("slope") * (n + 1))
        .withColumn("pred_adj", F.try_divide("pred", "sd"))
        .drop("_d", "_y")
    )


# ---------------------------------------------------------------- recursions


def linear_recurrence(
    df: DataFrame, by: Sequence[str], pos: str, a: str, b: str, name: str, rows_per_task: int = ROWS_PER_TASK, long_groups: bool | None = None
) -> DataFrame:
    """``y_t = a_t * y_{t-1} + b_t`` with ``y_0 = 0`` along ``pos`` (1, 2, ...) of each group.

    The recursion is linear, so a chunk of rows maps its start value ``s`` to ``A * s + B``.  Chunks
    run in parallel from zero, their (A, B) pairs are folded, and each chunk adds its own start.
    """
    by = list(by)
    chunked = df.withColumn("_chunk", F.floor((F.col(pos) - 1) / rows_per_task))
    schema = T.StructType([*chunked.schema.fields, T.StructField("_y", T.DoubleType()), T.StructField("_k", T.DoubleType())])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        y, k, ys, ks = 0.0, 1.0, [], []
        for ai, bi in zip(pdf[a].to_numpy(), pdf[b].to_numpy()):
            y, k = ai * y + bi, k * ai
            ys.append(y)
            ks.append(k)
        return pdf.assign(_y=ys, _k=ks)

    local = chunked.groupBy(*by, "_chunk").applyInPandas(scan, schema)
    if long_groups is None:
        long_groups = df.filter(F.col(pos) > rows_per_task).limit(1).count() > 0
    if not long_groups:
        return local.withColumn(name, F.col("_y")).drop("_y", "_k", "_chunk")
    ends = local.groupBy(*by, "_chunk").agg(F.max_by("_y", pos).alias("_ey"), F.max_by("_k", pos).alias("_ek"))
    w = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One entry per chunk of a group, so the list is rows / rows_per_task long.
    start = ends.select(*by, "_chunk", F.collect_list(F.struct("_ey", "_ek")).over(w).alias("_ends")).select(
        *by, "_chunk", F.aggregate("_ends", F.lit(0.0), lambda s, e: e["_ek"] * s + e["_ey"]).alias("_s")
    )
    return null_safe_join(local, start, [*by, "_chunk"]).withColumn(name, F.col("_y") + F.col("_k") * F.col("_s")).drop(
        "_y", "_k", "_s", "_chunk"
    )


def smooth_many(
    df: DataFrame, by: Sequence[str], order: str, specs: Mapping[str, tuple], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Exponential averages ``{name: (column, n, ratio)}``, each seeded with the mean of its first ``n``
    non-NULL values (NULL before); ``ratio`` None means 2/(n+1), Wilder's averages use 1/n.

    All of them run as one long-form recursion, so the input is read once.
    """
    by = list(by)
    cells = [
        F.struct(F.lit(k).alias("_spec"), F.lit(n).alias("_n"), F.lit(float(r or 2 / (n + 1))).alias("_r"), F.col(c).cast("double").alias("_x"))
        for k, (c, n, r) in specs.items()
    ]
    long = df.select(*by, order, F.inline(F.array(*cells))).filter("_x is not null")
    g = [*by, "_spec"]
    p = row_positions(long, [order], g, "_pos")
    seed = p.filter("_pos <= _n").groupBy(*g).agg(F.avg("_x").alias("_seed"))
    p = null_safe_join(p, seed, g).withColumns({
        "_a": F.when(F.col("_pos") <= F.col("_n"), 0.0).otherwise(1 - F.col("_r")),
        "_b": F.when(F.col("_pos") < F.col("_n"), 0.0).when(F.col("_pos") == F.col("_n"), F.col("_seed")).otherwise(F.col("_r") * F.col("_x")),
    })
    long_groups = hot_key(df, by, rows_per_task)
    y = linear_recurrence(p.select(*g, order, "_n", "_pos", "_a", "_b"), g, "_pos", "_a", "_b", "_v", rows_per_task, long_groups)
    wide = y.filter("_pos >= _n").groupBy(*by, order).pivot("_spec", list(specs)).agg(F.first("_v"))
    return null_safe_join(df, wide, [*by, order], "left")


def smooth(df: DataFrame, by, order: str, col: str, n: int, name: str, ratio: float | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    return smooth_many(df, by, order, {name: (col, n, ratio)}, rows_per_task)


def recursive_indicators(bars: DataFrame, by: str = "symbol", order: str = "date", n: int = 14, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """EMA, DEMA, ZLEMA (10), Wilder RSI, ATR, directional index and its average (``n``)."""

    def build(w):
        pc, ph, pl = [F.lag(x).over(w) for x in ("close", "high", "low")]
        up, down = F.col("high") - ph, pl - F.col("low")
        later = {
            "_gain": F.greatest(F.col("close") - pc, F.lit(0.0)),
            "_loss": F.greatest(pc - F.col("close"), F.lit(0.0)),
            "_tr": F.greatest(F.col("high"), pc) - F.least(F.col("low"), pc),
            "_up": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_down": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
        out = {k: F.when(pc.isNotNull(), c) for k, c in later.items()}
        return out | {"_delag": 2 * F.col("close") - F.lag("close", 4).over(w)}

    d = materialize(windowed(bars, [by], [order], build, 4, 0, rows_per_task))
    first = {"ema": ("close", 10, None), "zlema": ("_delag", 10, None)}
    first |= {f"w{c}": (c, n, 1 / n) for c in ("_gain", "_loss", "_tr", "_up", "_down")}
    d = smooth_many(d, [by], order, first, rows_per_task).withColumns({
        "rsi": 100 * F.try_divide(F.col("w_gain"), F.col("w_gain") + F.col("w_loss")),
        "atr": F.col("w_tr"),
        "dx": 100 * F.try_divide(F.abs(F.col("w_up") - F.col("w_down")), F.col("w_up") + F.col("w_down")),
    })
    d = materialize(d)
    d = smooth_many(d, [by], order, {"_ema2": ("ema", 10, None), "adx": ("dx", n, 1 / n)}, rows_per_task)
    d = d.withColumn("dema", 2 * F.col("ema") - F.col("_ema2"))
    return d.select(by, order, "ema", "dema", "zlema", "rsi", "atr", "dx", "adx")


def parabolic_sar(bars: DataFrame, by: str = "symbol", order: str = "date", step: float = 0.02, limit: float = 0.2) -> DataFrame:
    """Stop-and-reverse state machine per symbol.

    Its state is not linear, so a symbol is one group; a group holds one row per bar date and is
    therefore bounded by the calendar, however many trades make up a bar.
    """
    schema = T.StructType([bars.schema[by], bars.schema[order], T.StructField("sar", T.DoubleType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        hi, lo = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        rising, sar, top, rate, out = True, lo[0], hi[0], step, [float("nan")]
        for i in range(1, len(pdf)):
            sar = sar + rate * (top - sar)
            guard = lo[max(0, i - 2) : i].min() if rising else hi[max(0, i - 2) : i].max()
            sar = min(sar, guard) if rising else max(sar, guard)
            if (rising and lo[i] < sar) or (not rising and hi[i] > sar):
                rising, sar, rate = not rising, top, step
                top = hi[i] if rising else lo[i]
            elif (rising and hi[i] > top) or (not rising and lo[i] < top):
                top = hi[i] if rising else lo[i]
                rate = min(limit, rate + step)
            out.append(sar)
        return pd.DataFrame({by: pdf[by], order: pdf[order], "sar": out})

    return bars.select(by, order, "high", "low").groupBy(by).applyInPandas(walk, schema)
