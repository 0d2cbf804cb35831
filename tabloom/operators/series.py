"""Multi-series time-series operators.

Input is one row per (series, step), so a series is bounded by the calendar; where a table may
hold more (duplicates), the sliced primitives of ``order`` are used.  Nothing is sorted globally.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.operators.joins import asof_join, checked_join, range_join
from tabloom.operators.order import bin_right_closed, cut, group_transform, hash_order, null_safe_join, qcut, quantiles, row_positions, windowed
from tabloom.operators.reshape import pairwise_correlation
from tabloom.session import materialize, small_side
from tabloom.spec import SeriesSpec

DAY = 86400.0


def seconds(c) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")) / 1e6


def steps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with ``step``: seconds since the previous row of the series (NULL on the first)."""
    spec.check(df)
    t = spec.date_col
    return windowed(df, [spec.series_id], [t], lambda w: {"step": seconds(t) - F.lag(seconds(t)).over(w)}, 1)


def median_step(st: DataFrame) -> DataFrame:
    """One row with the median step of the table.

    Steps take few distinct values, so they are counted first and the median comes from the counts.
    """
    return quantiles(st.filter("step is not null"), "step", [0.5], slices=4).select(F.col("q0").alias("median_step"))


def series_lengths(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series: rows, start, end, longest step, and that step in median steps."""
    st = steps(df, spec)
    g = st.groupBy(spec.series_id).agg(
        F.count(F.lit(1)).alias("rows"), F.min(spec.date_col).alias("start"), F.max(spec.date_col).alias("end"),
        F.max("step").alias("max_step"),
    )
    return g.crossJoin(F.broadcast(median_step(st))).withColumn("max_gap", F.try_divide("max_step", "median_step")).drop("median_step")


def series_summary(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row about the whole table: size, target range, number of series, span and steps."""
    st = steps(df, spec)
    per = st.groupBy(spec.series_id).agg(
        F.count(F.lit(1)).alias("n"), F.min(spec.target).alias("lo"), F.max(spec.target).alias("hi"),
        F.min(spec.date_col).alias("a"), F.max(spec.date_col).alias("b"), F.min("step").alias("s"), F.max("step").alias("l"),
    )
    row = per.agg(
        F.sum("n").alias("rows"), F.lit(len(df.columns)).alias("cols"), F.min("lo").alias("min_target"), F.max("hi").alias("max_target"),
        F.count(F.lit(1)).alias("series"), F.min("a").alias("start"), F.max("b").alias("end"),
        F.min("s").alias("min_step"), F.max("l").alias("max_step"), F.min("n").alias("min_length"), F.max("n").alias("max_length"),
    )
    out = row.withColumn("span_days", (seconds("end") - seconds("start")) / DAY)
    return out.crossJoin(F.broadcast(median_step(st)))


UNITS = (("minute", 60.0, 3600.0), ("hour", 3600.0, DAY), ("day", DAY, 7 * DAY), ("week", 7 * DAY, 2628000.0))


def infer_timestep(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``unit, n`` of the median step; a step that no unit divides is an error.

    Calendar months differ in length: 28 to 31 days between equal days of the month count as one month.
    """
    st = steps(df, spec)
    s = F.col("median_step")
    unit, n = F, F
    for name, size, upto in UNITS:
        hit = (s >= size) & (s < upto) & (s % size == 0)
        unit, n = unit.when(hit, name), n.when(hit, s / size)
    month = (s >= 28 * DAY) & (s <= 31 * DAY)
    row = median_step(st).withColumns({
        "unit": F.when(month, "month").otherwise(unit),
        "n": F.when(month, 1).otherwise(n).cast("int"),
    })
    bad = F.raise_error(F.concat(F.lit("no unit divides the step of "), s.cast("string"), F.lit(" seconds")))
    return row.select("median_step", F.when(F.col("unit").isNotNull(), F.col("unit")).otherwise(bad).alias("unit"), "n")


def infer_season(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Season length from the smallest step: minutes 60, hours 24, days 7, weeks 52, months 12, quarters 4, else 1."""
    s = F.min("step").alias("min_step")
    m = F.col("min_step")
    season = (
        F.when(m < 60, 60).when(m < 3600, 1440).when(m < DAY, 24).when(m < 7 * DAY, 7)
        .when(m < 28 * DAY, 52).when(m < 89 * DAY, 12).when(m < 360 * DAY, 4).otherwise(1)
    )
    return steps(df, spec).agg(s).withColumn("season", season)


def pct_missing(df: DataFrame, col: str, token=None) -> DataFrame:
    bad = F.col(col).isNull() | (F.isnan(F.col(col)) if dict(df.dtypes)[col] in ("double", "float") else F.lit(False))
    if token is not None:
        bad = bad | (F.col(col) == F.lit(token))
    return df.agg(F.avg(F.coalesce(bad, F.lit(True)).cast("int")).alias("missing"))


def zero_inflated(df: DataFrame, spec: SeriesSpec, cutoff: float = 0.99) -> DataFrame:
    """Series whose share of zeros among the non-NULL targets reaches ``cutoff``."""
    share = F.avg((F.col(spec.target) == 0).cast("int")).alias("zero_share")
    return df.groupBy(spec.series_id).agg(share).filter(F.col("zero_share") >= cutoff)


def drop_zero_inflated(df: DataFrame, spec: SeriesSpec, cutoff: float = 0.99) -> DataFrame:
    return df.join(zero_inflated(df, spec, cutoff), spec.series_id, "left_anti")


def time_steps(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Each row's step in units of the median step."""
    st = steps(df, spec)
    return st.crossJoin(F.broadcast(median_step(st))).withColumn("steps", F.try_divide("step", "median_step")).drop("step", "median_step")


def hierarchical_check(df: DataFrame, spec: SeriesSpec, share: float = 0.95) -> DataFrame:
    """Passed if more than 95 % of the dates have more than 95 % of the series."""
    per = df.groupBy(spec.date_col).agg(F.count(spec.series_id).alias("n"))
    total = df.select(spec.series_id).distinct().agg(F.count(F.lit(1)).alias("series"))
    full = F.avg((F.col("n") / F.col("series") > share).cast("int"))
    return _check("hierarchical", per.crossJoin(F.broadcast(total)).agg(full.alias("value")), F.col("value") > share)


def _check(name: str, row: DataFrame, passed: Column) -> DataFrame:
    return row.select(F.lit(name).alias("check"), F.col("value").cast("double").alias("value"), passed.alias("passed"))


def negative_check(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Share of series with a negative target."""
    per = df.groupBy(spec.series_id).agg(F.bool_or(F.col(spec.target) < 0).alias("b"))
    return _check("negative", per.agg(F.avg(F.coalesce("b", F.lit(False)).cast("int")).alias("value")), F.col("value") == 0)


def edge_checks(df: DataFrame, spec: SeriesSpec, days: int = 30) -> DataFrame:
    """Shares of series that start late (new) and that end early (old), by ``days``."""
    t = spec.date_col
    per = df.groupBy(spec.series_id).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    ends = per.agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    j = per.crossJoin(F.broadcast(ends))
    new = j.agg(F.avg((seconds("a") - seconds("lo") > days * DAY).cast("int")).alias("value"))
    old = j.agg(F.avg((seconds("hi") - seconds("b") > days * DAY).cast("int")).alias("value"))
    return _check("new_series", new, F.col("value") == 0).unionByName(_check("old_series", old, F.col("value") == 0))


def duplicate_dates(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.groupBy(spec.series_id, spec.date_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gap_check(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Share of series whose longest step exceeds the median step."""
    per = series_lengths(df, spec)
    return _check("gap", per.agg(F.avg((F.coalesce("max_gap", F.lit(0.0)) > 1).cast("int")).alias("value")), F.col("value") == 0)


PARTS = {
    "minute": F.minute, "hour": F.hour, "day": F.weekday, "week": F.weekofyear, "month": F.month,
}
INTERVALS = {u: f"interval 1 {u}" for u in ("minute", "hour", "day", "week", "month")}


def fill_dates(df: DataFrame, spec: SeriesSpec, unit: str = "day", n: int = 1) -> DataFrame:
    """Missing steps between each series' own first and last date, other columns NULL.

    Weeks and months step from the first date of the series.
    """
    s, t = spec.series_id, spec.date_col
    span = df.groupBy(s).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = span.select(s, F.explode(F.sequence("_a", "_b", F.expr(f"interval {n} {unit}"))).alias(t))
    return grid.join(df, [s, t], "left")


def irregular_series(df: DataFrame, spec: SeriesSpec, unit: str, common: float = 0.3, presence: float = 0.8) -> DataFrame:
    """(series, calendar bin) pairs present on fewer than 80 % of their dates.

    Bins with under 30 % of the rows of the most common bin are left out.
    """
    s, t = spec.series_id, spec.date_col
    part = PARTS[unit](t).alias("bin")
    counts = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    usual = counts.crossJoin(F.broadcast(top)).filter(F.col("n") >= common * F.col("top")).select("bin")
    filled = fill_dates(df.withColumn("_i", F.lit(1)), spec, unit).withColumn("bin", PARTS[unit](t))
    share = filled.join(F.broadcast(usual), "bin", "left_semi").groupBy(s, "bin").agg((F.sum("_i") / F.count(F.lit(1))).alias("presence"))
    return share.filter(F.col("presence").isNull() | (F.col("presence") < presence))


CYCLES = {"moh": ("hourly", F.minute), "hod": ("daily", F.hour), "dow": ("weekly", F.weekday), "dom": ("monthly", F.dayofmonth), "month": ("yearly", F.month)}
CYCLES_BY_UNIT = {
    "minute": ["moh", "hod", "dow", "dom", "month"], "hour": ["hod", "dow", "dom", "month"], "day": ["dow", "dom", "month"], "week": ["month"], "month": ["month"],
}


def periodicity(df: DataFrame, spec: SeriesSpec, unit: str, alpha: float = 0.05) -> DataFrame:
    """Calendar parts with a level that differs from the first level: ``part, period, max_z, detected``.

    A Gaussian model with one dummy per level is fitted by the level means, and the z value of a
    dummy follows from counts, sums and squares: one aggregation for all parts.
    """
    y = F.col(spec.target)
    cells = [F.struct(F.lit(k).alias("part"), CYCLES[k][1](spec.date_col).cast("string").alias("level")) for k in CYCLES_BY_UNIT[unit]]
    long = df.filter(y.isNotNull() & (F.abs(y) < float("inf"))).select(y.alias("_y"), F.inline(F.array(*cells)))
    mean = long.agg(F.avg("_y").alias("_c"))
    g = long.crossJoin(F.broadcast(mean)).withColumn("_y", F.col("_y") - F.col("_c")).groupBy("part", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") ** 2).alias("q")
    )
    w = Window.partitionBy("part")  # at most 60 levels per part
    first = F.min_by(F.struct((F.col("s") / F.col("n")).alias("m"), F.col("n").alias("n")), "level").over(w)
    rss = F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).over(w)
    scale = rss / (F.sum("n").over(w) - F.count(F.lit(1)).over(w))
    z = g.withColumns({"_f": first, "_scale": scale, "_lo": F.min("level").over(w)}).filter("level <> _lo")
    value = F.abs((F.col("s") / F.col("n") - F.col("_f.m")) / F.sqrt(F.col("_scale") * (1 / F.col("n") + 1 / F.col("_f.n"))))
    limit = NormalDist().inv_cdf(1 - alpha / 2)
    names = F.create_map(*[F.lit(x) for k, (v, _) in CYCLES.items() for x in (k, v)])
    out = z.groupBy("part").agg(F.max(value).alias("max_z"))
    return out.select("part", F.element_at(names, F.col("part")).alias("period"), "max_z", (F.col("max_z") >= limit).alias("detected"))


def trim_zeros(df: DataFrame, spec: SeriesSpec, lead: int = 5, trail: int = 5, drop: bool = False) -> DataFrame:
    """Zeros before the first and after the last non-zero target, if at least ``lead`` / ``trail``
    non-NULL rows lie there: rows dropped, or targets set to NULL.  All-zero series go entirely."""
    s, t, y = spec.series_id, F.col(spec.date_col), F.col(spec.target)
    seen = F.when(y != 0, t)
    ends = df.groupBy(s).agg(F.min(seen).alias("_a"), F.max(seen).alias("_b"))
    j = null_safe_join(df, ends, [s])
    sides = null_safe_join(df, ends, [s]).groupBy(s).agg(
        F.count(F.when(t < F.col("_a"), y)).alias("_lead"), F.count(F.when(t > F.col("_b"), y)).alias("_trail")
    )
    j = null_safe_join(j, sides, [s])
    empty = F.col("_a").isNull()
    out = empty | ((F.col("_lead") >= lead) & (t < F.col("_a"))) | ((F.col("_trail") >= trail) & (t > F.col("_b")))
    out = F.coalesce(out, F.lit(False))
    j = j.filter(~out) if drop else j.withColumn(spec.target, F.when(~out, y))
    return j.select(*df.columns)


def drop_gappy(df: DataFrame, spec: SeriesSpec, max_gap: float, dropped: bool = False) -> DataFrame:
    """Rows of series whose longest step is at most ``max_gap`` median steps (or of the others)."""
    ok = series_lengths(df, spec).filter(F.coalesce("max_gap", F.lit(0.0)) <= max_gap).select(spec.series_id)
    return df.join(ok, spec.series_id, "left_anti" if dropped else "left_semi")


CROSS_FUNCS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def cross_series_features(df: DataFrame, group: Sequence[str], cols: Sequence[str], funcs: Sequence[str]) -> DataFrame:
    return group_transform(df, group, {f"{c}_{f}": CROSS_FUNCS[f](c) for c in cols for f in funcs})


# ---------------------------------------------------------------- calendars


def nth_weekday(year: Column, month: int, n: int, day: str) -> Column:
    """n-th given weekday of a month."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def observed(d: Column) -> Column:
    """Nearest working day: Saturday -> Friday, Sunday -> Monday."""
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def holiday_rules(y: Column) -> dict[str, Column]:
    """Fixed rules of the US federal calendar, with two shopping days; Christmas and 4 July unshifted."""

    def day(m, d):
        return F.make_date(y, F.lit(m), F.lit(d))

    thanks = nth_weekday(y, 11, 4, "Thu")
    return {
        "New Year's Day": observed(day(1, 1)),
        "Martin Luther King Jr. Day": nth_weekday(y, 1, 3, "Mon"),
        "Presidents Day": nth_weekday(y, 2, 3, "Mon"),
        "Memorial Day": F.next_day(day(5, 24), "Mon"),
        "Juneteenth": F.when(y >= 2021, observed(day(6, 19))),
        "July 4th": day(7, 4),
        "Labor Day": nth_weekday(y, 9, 1, "Mon"),
        "Columbus Day": nth_weekday(y, 10, 2, "Mon"),
        "Veterans Day": observed(day(11, 11)),
        "Thanksgiving": thanks,
        "Black Friday": F.date_add(thanks, 1),
        "Cyber Monday": F.date_add(thanks, 4),
        "Christmas": day(12, 25),
    }


def holiday_calendar(df: DataFrame, date_col: str, extra: DataFrame | None = None) -> DataFrame:
    """Holidays from the first date of the table to a year after its last: ``Date, Event``, in order."""
    span = df.agg(F.to_date(F.min(date_col)).alias("a"), F.date_add(F.to_date(F.max(date_col)), 365).alias("b"))
    years = span.select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b") + 1)).alias("y"))
    cells = [F.struct(d.alias("Date"), F.lit(n).alias("Event")) for n, d in holiday_rules(F.col("y")).items()]
    out = years.select("a", "b", F.inline(F.array(*cells))).filter("Date between a and b").select("Date", "Event")
    if extra is not None:
        out = out.unionByName(extra.select(F.to_date(extra.columns[0]).alias("Date"), F.col(extra.columns[1]).alias("Event")))
    return out.distinct().orderBy("Date", "Event")


def events_on_series(df: DataFrame, spec: SeriesSpec, calendar: DataFrame, unit: str = "day") -> DataFrame:
    """Mean target per date with the events that fall on it (weekly data: within the 7 days from it)."""
    avg = df.groupBy(spec.date_col).agg(F.avg(spec.target).alias("target"))
    eps = 7 if unit == "week" else 0
    cal = calendar.select(F.col("date").alias("event_date"), "event").withColumn("_low", F.date_sub("event_date", eps).cast("timestamp"))
    return range_join(avg, spec.date_col, cal, "_low", "event_date").drop("_low")


def event_distance_cols(df: DataFrame, date_col: str, calendar: DataFrame, names: Sequence[str]) -> DataFrame:
    """Days to the next and since the last event, overall and per event name.

    As-of joins run on the distinct dates only, all names at once, and are then joined back.
    """
    dates = df.select(F.col(date_col).alias("_d")).distinct()
    keyed = calendar.select(F.col("date").alias("_d"), F.explode(F.array(F.lit("any"), F.col("event"))).alias("_e")).distinct()
    left = dates.withColumn("_e", F.explode(F.array(*[F.lit(n) for n in ("any", *names)])))
    back = asof_join(left, keyed, ["_e"], "_d", "backward")
    both = asof_join(back.withColumnRenamed("_d_right", "_last"), keyed, ["_e"], "_d", "forward")
    wide = both.groupBy("_d").pivot("_e", ["any", *names]).agg(
        F.first(F.datediff("_d_right", "_d")).alias("days_to"), F.first(F.datediff("_d", "_last")).alias("days_since")
    )
    return df.join(wide.withColumnRenamed("_d", date_col), date_col, "left")


# ---------------------------------------------------------------- shape and clusters


def sax(df: DataFrame, spec: SeriesSpec, n_bins: int = 5, strategy: str = "quantile") -> DataFrame:
    """Per series: SAX text, length, distinct values and share of each letter.

    Only series longer than ``n_bins`` with more than one value have a text.
    """
    s, y = spec.series_id, spec.target
    probs = [i / n_bins for i in range(1, n_bins)]
    if strategy == "quantile":
        edges = quantiles(df, y, probs, [s]).withColumnsRenamed({f"q{i}": f"_e{i}" for i in range(len(probs))})
    else:
        z = [NormalDist().inv_cdf(p) for p in probs]
        edges = df.groupBy(s).agg(*[(F.avg(y) + v * F.stddev_pop(y)).alias(f"_e{i}") for i, v in enumerate(z)])
    rank = sum([(F.col(y) > F.col(f"_e{i}")).cast("int") for i in range(len(probs))], F.lit(0))
    j = df.join(edges, s).withColumn("_l", F.chr(F.lit(97) + rank))
    letters = F.transform(F.array_sort(F.collect_list(F.struct(spec.date_col, "_l"))), lambda x: x["_l"])
    g = j.groupBy(s).agg(F.concat_ws("", letters).alias("sax"), F.count(y).alias("length"), F.count_distinct(y).alias("distinct"))
    g = g.filter((F.col("length") > n_bins) & (F.col("distinct") > 1))
    return g.withColumns({
        f"pct_{chr(97 + i)}": F.regexp_count("sax", F.lit(chr(97 + i))) / F.length("sax") for i in range(n_bins)
    })


def _lagged(df: DataFrame, spec: SeriesSpec, nlags: int) -> DataFrame:
    """``series, x0 .. x<nlags>``: every value, less its series' mean, beside those before it; NULL targets are left out."""
    s, t, y = spec.series_id, spec.date_col, spec.target
    x = group_transform(df.where(F.col(y).isNotNull()).select(s, t, F.col(y).cast("double").alias("_y")), [s], {"_mean": F.avg("_y")}).withColumn("x0", F.col("_y") - F.col("_mean"))
    return windowed(x, [s], [t], lambda w: {f"x{i}": F.lag("x0", i).over(w) for i in range(1, nlags + 1)}, lookback=nlags).select(s, *[f"x{i}" for i in range(nlags + 1)])


def lag_products(df: DataFrame, spec: SeriesSpec, nlags: int) -> DataFrame:
    """``series, n, c``: how many values a series has, and the sums of x(t) x(t - i) for i in 0..nlags of the centred values."""
    x = _lagged(df, spec, nlags)
    return x.groupBy(spec.series_id).agg(F.count("x0").alias("n"), F.array(*[F.coalesce(F.sum(F.col("x0") * F.col(f"x{i}")), F.lit(0.0)) for i in range(nlags + 1)]).alias("c"))


def levinson(c: Column, nlags: int) -> Column:
    """Partial autocorrelations 1..nlags from lag products by the Durbin-Levinson recursion, a fold over the lags; NULL for a constant series."""
    dot = lambda phi, r: F.aggregate(F.zip_with(phi, r, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    r = F.transform(F.slice(c, 2, nlags), lambda v: F.try_divide(v, F.get(c, F.lit(0))))
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("out"))

    def step(acc, k):
        before = acc["phi"]
        back = F.reverse(F.slice(r, F.lit(1), k - 1))
        new = F.try_divide(F.element_at(r, k) - dot(before, back), 1 - dot(before, F.slice(r, F.lit(1), k - 1)))
        phi = F.array_append(F.zip_with(before, F.reverse(before), lambda p, q: p - new * q), new)
        return F.struct(phi.alias("phi"), F.array_append(acc["out"], new).alias("out"))

    return F.when(F.get(c, F.lit(0)) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), start, step)["out"])


def _normal_sums(nlags: int) -> dict[str, Column]:
    """What least squares on up to ``nlags`` lags needs of the rows that have them, by the number of lags."""
    out = {}
    for k in range(1, nlags + 1):
        there = lambda c, k=k: F.coalesce(F.sum(F.when(F.col(f"x{k}").isNotNull(), c)), F.lit(0.0))
        out |= {f"s{k}_{i}_{j}": there(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k + 1) for j in range(i, k + 1)} | {f"s{k}_{i}": there(F.col(f"x{i}")) for i in range(k + 1)}
    return out


def pacf_features(df: DataFrame, spec: SeriesSpec, nlags: int = 7, alpha: float | None = 0.05, method: str = "ols") -> DataFrame:
    """``series, pacf_1 ..``: partial autocorrelations, 0 inside the band z/sqrt(n), NaN for lags beyond half the series and constant series.

    ``ols`` takes the last coefficient of least squares on the lags, ``levinson`` the Durbin-Levinson recursion.  Both start from sums of lag products,
    so no task holds a series; scaling a series changes neither.
    """
    s = spec.series_id
    names_ = [f"pacf_{k}" for k in range(1, nlags + 1)]
    band = (NormalDist().inv_cdf(1 - alpha / 2) if alpha else 0.0) / F.sqrt("n")
    limit = F.floor((F.col("n") - 1) / 2)
    shown = lambda v, k: F.when((F.lit(k) > limit) | v.isNull() | F.isnan(v), float("nan")).when(F.abs(v) > band, v).otherwise(0.0).alias(f"pacf_{k}")
    if method == "levinson":
        g = lag_products(df, spec, nlags).withColumn("_p", levinson(F.col("c"), nlags))
        return g.select(s, *[shown(F.get("_p", F.lit(k - 1)), k) for k in range(1, nlags + 1)])
    if method != "ols":
        raise ValueError("method must be ols or levinson")
    sums = list(_normal_sums(nlags))
    g = _lagged(df, spec, nlags).groupBy(s).agg(F.count("x0").alias("n"), F.sum(F.col("x0") * F.col("x0")).alias("_ss"), *[c.alias(n) for n, c in _normal_sums(nlags).items()])

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "_ss", *sums)}
            out = []
            for k in range(1, nlags + 1):
                m = np.empty((len(batch), k + 1, k + 1))
                m[:, 0, 0] = col["n"] - k
                for i in range(1, k + 1):
                    m[:, 0, i] = m[:, i, 0] = col[f"s{k}_{i}"]
                    for j in range(i, k + 1):
                        m[:, i, j] = m[:, j, i] = col[f"s{k}_{i}_{j}"]
                right = np.stack([col[f"s{k}_0"], *[col[f"s{k}_0_{i}"] for i in range(1, k + 1)]], axis=1)
                fit = (col["_ss"] > 0) & (col["n"] > 2 * k)
                last = np.full(len(batch), np.nan)
                if fit.any():
                    last[fit] = (np.linalg.pinv(m[fit], rcond=1e-13, hermitian=True) @ right[fit][:, :, None])[:, -1, 0]
                out.append(pa.array(last))
            yield pa.RecordBatch.from_arrays([batch.column(s), batch.column("n"), *out], names=[s, "n", *names_])

    kind = df.schema[s].dataType.simpleString()
    solved = g.mapInArrow(solve, f"`{s}` {kind}, n long, " + ", ".join(f"{c} double" for c in names_))
    return solved.select(s, *[shown(F.col(c), k) for k, c in enumerate(names_, 1)])


def series_distance(df: DataFrame, spec: SeriesSpec, method: str = "correlation", nlags: int = 7, anchors: DataFrame | None = None) -> DataFrame:
    """Correlation, or squared-then-rooted distance of PACF vectors, for every pair of series, or for those with one of ``anchors``.

    The PACF form reuses the blocked product sums: d^2 = |a|^2 + |b|^2 - 2 a.b over the lags.
    """
    if method == "correlation":
        return pairwise_correlation(df, spec.series_id, spec.date_col, spec.target, anchors=anchors)
    if method != "pacf":
        raise ValueError("method must be correlation or pacf")
    f = materialize(pacf_features(df, spec, nlags))
    long = f.unpivot([spec.series_id], [c for c in f.columns if c != spec.series_id], "_lag", "_v").filter("not isnan(_v)")
    from tabloom.operators.reshape import pairwise_sums

    sums = pairwise_sums(long, spec.series_id, "_lag", "_v", anchors=anchors)
    return sums.select("series_1", "series_2", F.sqrt(F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0))).alias("distance"))


def split_series(df: DataFrame, spec: SeriesSpec, by: str = "quantile", cuts: int = 5) -> DataFrame:
    """``cluster``: quantile or equal-width bin of the series mean, numbered 1..n in bin order."""
    m = df.groupBy(spec.series_id).agg(F.avg(spec.target).alias("_m"))
    binned = qcut(m, "_m", cuts, "_b", "drop") if by == "quantile" else cut(m, "_m", cuts, "_b")
    labels = binned.select("_b").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("_b")))  # <= cuts rows
    return df.join(binned.join(F.broadcast(labels), "_b").select(spec.series_id, "cluster"), spec.series_id)


def cluster_features(features: DataFrame, key: str, cols: Sequence[str], k: int | None = None, max_k: int = 8, seed: int = 1) -> DataFrame:
    """KMeans label per key; with ``k`` None, the k in 2..max_k of the largest silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = materialize(VectorAssembler(inputCols=list(cols), outputCol="features").transform(features.fillna(0.0, list(cols))).select(key, "features"))

    fit = lambda n: KMeans(k=n, seed=seed).fit(x)
    if k is None:
        judge, models = ClusteringEvaluator(), {n: fit(n) for n in range(2, min(max_k, x.count() - 1) + 1)}
        model = models[max(models, key=lambda n: judge.evaluate(models[n].transform(x)))]
    else:
        model = fit(k)
    return model.transform(x).select(key, (F.col("prediction") + 1).alias("cluster"))


def medoids(d, k: int):
    """Row numbers of ``k`` medoids of the distance matrix ``d``: greedy choice, then swaps while they lower the sum of distances."""
    import numpy as np

    chosen = [int(d.sum(axis=1).argmin())]
    while len(chosen) < k:
        near = d[chosen].min(axis=0)
        chosen.append(int(np.maximum(near[None, :] - d, 0).sum(axis=1).argmax()))
    best = d[chosen].min(axis=0).sum()
    while True:
        swaps = [(np.minimum(np.delete(d[chosen], i, axis=0).min(axis=0, initial=np.inf)[None, :], d).sum(axis=1), i) for i in range(k)]
        cost, i = min(((c.min(), i) for c, i in swaps), key=lambda x: x[0])
        if cost >= best * (1 - 1e-12) - 1e-12:
            return sorted(chosen)
        chosen[i], best = int(swaps[i][0].argmin()), cost


def silhouette(d, label) -> float:
    """Mean silhouette of the rows of the distance matrix ``d``; a row alone in its cluster counts 0."""
    import numpy as np

    groups = np.unique(label)
    means = np.stack([(d[:, label == g].sum(axis=1) - 0.0) / np.maximum(1, (label == g).sum() - (label == g)) for g in groups], axis=1)
    own = means[np.arange(len(d)), np.searchsorted(groups, label)]
    other = np.where(groups[None, :] == label[:, None], np.inf, means).min(axis=1)
    alone = np.array([(label == x).sum() == 1 for x in label])
    return float(np.where(alone | ~np.isfinite(other), 0.0, (other - own) / np.maximum(np.maximum(own, other), 1e-300)).mean())


def distance_clusters(df: DataFrame, spec: SeriesSpec, method: str = "correlation", k: int | None = None, max_k: int = 8, nlags: int = 7, landmarks: int = 256, seed: int = 1) -> DataFrame:
    """``series, cluster, medoid, distance``: k-medoids on the distances of T-23 (``1 - correlation``, or that of the PACF vectors).

    ``landmarks`` series, drawn by hash, are compared with all others by block products; medoids are sought among them on the driver, which holds
    landmarks x landmarks numbers, and with ``k`` None the number in 2..max_k of the largest silhouette is taken.  Every series then
    goes to its nearest medoid.  Series without a distance to another (no shared dates, constant) are as far from it as can be.
    """
    import numpy as np

    s = spec.series_id
    every = df.select(s).distinct()
    chosen = materialize(row_positions(every.withColumn("_h", hash_order(s, seed=seed)), ["_h", s], name="_at").filter(F.col("_at") <= landmarks).select(s))
    d = series_distance(df, spec, method, nlags, chosen)
    d = d.select("series_1", "series_2", (1 - F.col("corr")).alias("d")) if method == "correlation" else d.withColumnRenamed("distance", "d")
    d = materialize(d.where("d is not null"))
    names = sorted(r[0] for r in chosen.collect())
    number = {x: i for i, x in enumerate(names)}
    far = 2.0 if method == "correlation" else float((d.agg(F.max("d")).first()[0] or 0.0) + 1.0)
    inside = d.join(F.broadcast(chosen.withColumnRenamed(s, "series_2")), "series_2", "left_semi").collect()
    m = np.full((len(names), len(names)), far)
    np.fill_diagonal(m, 0.0)
    for r in inside:
        m[number[r.series_1], number[r.series_2]] = m[number[r.series_2], number[r.series_1]] = r.d
    tried = [k] if k is not None else list(range(2, min(max_k, len(names) - 1) + 1)) or [1]
    found = [medoids(m, min(n, len(names))) for n in tried] if names else [[]]
    best = max(found, key=lambda c: silhouette(m, m[c].argmin(axis=0))) if len(found) > 1 else found[0]
    centre = [names[i] for i in best]
    label = F.broadcast(df.sparkSession.createDataFrame([(x, i + 1) for i, x in enumerate(centre)], T.StructType([T.StructField("medoid", df.schema[s].dataType), T.StructField("cluster", T.IntegerType())])))
    both = d.select(F.col("series_1").alias("medoid"), F.col("series_2").alias(s), "d").unionByName(d.select(F.col("series_2").alias("medoid"), F.col("series_1").alias(s), "d"))
    near = every.crossJoin(label).join(both, ["medoid", s], "left").withColumn("d", F.when(F.col("medoid") == F.col(s), 0.0).otherwise(F.coalesce("d", F.lit(far))))
    return near.groupBy(s).agg(F.min(F.struct("d", "cluster", "medoid")).alias("_n")).select(s, F.col("_n.cluster").alias("cluster"), F.col("_n.medoid").alias("medoid"), F.col("_n.d").alias("distance"))


def cluster_series(df: DataFrame, spec: SeriesSpec, method: str = "pacf", k: int | None = None, max_k: int = 8, nlags: int = 7) -> DataFrame:
    """``series, cluster`` by KMeans on PACF vectors or means, or by k-medoids on distances (``correlation``, ``pacf_distance``)."""
    if method in ("correlation", "pacf_distance"):
        return distance_clusters(df, spec, method.split("_")[0], k, max_k, nlags).select(spec.series_id, "cluster")
    if method == "pacf":
        f = materialize(pacf_features(df, spec, nlags))
        cols = [c for c in f.columns if c != spec.series_id]
        f = f.select(spec.series_id, *[F.nanvl(c, F.lit(0.0)).alias(c) for c in cols])
    elif method == "mean":
        f, cols = df.groupBy(spec.series_id).agg(F.avg(spec.target).alias("mean")), ["mean"]
    else:
        raise ValueError("method must be pacf, mean, correlation or pacf_distance")
    return cluster_features(f, spec.series_id, cols, k, max_k)


def corr_clusters(df: DataFrame, spec: SeriesSpec, cuts: Sequence[float]) -> DataFrame:
    """For each falling cut, the series with most partners above it and those partners form a cluster;
    the rest goes on.  ``cut, hub, member``.  Correlations are computed once; a round is a degree
    count and an anti join."""
    s = spec.series_id
    c = pairwise_correlation(df, s, spec.date_col, spec.target).filter(F.col("corr") > min(cuts)).select("series_1", "series_2", "corr")
    links = materialize(c.select(F.inline(F.array(
        F.struct(F.col("series_1").alias("a"), F.col("series_2").alias("b"), "corr"), F.struct(F.col("series_2").alias("a"), F.col("series_1").alias("b"), "corr"),
    ))))
    left = materialize(df.select(F.col(s).alias("a")).distinct())
    out = None
    for level in cuts:
        live = links.filter(F.col("corr") > level).join(left, "a", "left_semi").join(left.select(F.col("a").alias("b")), "b", "left_semi")
        degree = left.join(live.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "left").fillna({"n": 0})
        hub = degree.agg(F.min_by("a", F.struct(-F.col("n"), F.col("a"))).alias("hub")).filter("hub is not null")
        near = live.join(F.broadcast(hub), F.col("a") == F.col("hub")).select("hub", F.col("b").alias("member"))
        got = materialize(hub.select("hub", F.col("hub").alias("member")).unionByName(near))
        left = materialize(left.join(got.select(F.col("member").alias("a")), "a", "left_anti"))
        part = got.select(F.lit(level).alias("cut"), "hub", "member")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- accuracy and baselines


def accuracy_by(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Metrics per key combination and for the whole table (keys NULL), one pass by grouping sets."""
    return df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(*[c.alias(n) for n, c in metrics.items()])


def merge_preds_actuals(preds: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions with their actuals; actual keys must be unique."""
    return checked_join(preds, actuals, keys, "left", "m:1")


def forecast_baselines(df: DataFrame, spec: SeriesSpec, horizon: int, season: int) -> DataFrame:
    """Mean, drift and seasonal-naive forecasts for 1..horizon steps: ``series, h, mean, drift, snaive``."""
    s, t, y = spec.series_id, spec.date_col, spec.target
    from tabloom.operators.order import row_positions

    p = row_positions(df, [t], [s], "_pos")
    g = p.groupBy(s).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(y).alias("mean"), F.min_by(y, "_pos").alias("_first"), F.max_by(y, "_pos").alias("_last")
    )
    n = null_safe_join(p, g.select(s, "_n"), [s])
    tail = n.filter(F.col("_pos") > F.col("_n") - season).groupBy(s).agg(F.sort_array(F.collect_list(F.struct("_pos", y))).alias("_tail"))
    h = F.col("h")
    return (
        g.join(tail, s)
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(
            s, "h", "mean",
            (F.col("_last") + h * F.try_divide(F.col("_last") - F.col("_first"), F.col("_n") - 1)).alias("drift"),
            F.get("_tail", ((h - 1) % F.size("_tail")).cast("int"))[y].alias("snaive"),
        )
    )


def exponential_smoothing(df: DataFrame, spec: SeriesSpec, alphas: Sequence[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """Simple exponential smoothing; per series the alpha of least squared one-step error and the level.

    All alphas run as one linear recursion per (series, alpha), so no fitting loop runs per series.
    """
    from tabloom.operators.order import row_positions
    from tabloom.operators.windows import linear_recurrence

    s, t, y = spec.series_id, spec.date_col, spec.target
    p = row_positions(df.filter(F.col(y).isNotNull()).select(s, t, y), [t], [s], "_pos")
    long = p.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    first = F.col("_pos") == 1
    long = long.withColumns({
        "_a": F.when(first, 0.0).otherwise(1 - F.col("alpha")),
        "_b": F.when(first, F.col(y)).otherwise(F.col("alpha") * F.col(y)),
    })
    lv = linear_recurrence(long, [s, "alpha"], "_pos", "_a", "_b", "_level")
    # level_t = alpha*y_t + (1-alpha)*level_{t-1}, so the one-step error is (y_t - level_t) / (1 - alpha).
    err = F.when(~(F.col("_pos") == 1), (F.col(y) - F.col("_level")) / (1 - F.col("alpha")))
    g = lv.groupBy(s, "alpha").agg(F.avg(err * err).alias("mse"), F.max_by("_level", "_pos").alias("forecast"))
    return g.groupBy(s).agg(F.min_by(F.struct("alpha", "mse", "forecast"), F.struct("mse", "alpha")).alias("r")).select(s, "r.*")


def detrend(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Adds ``trend`` (line in days fitted per series) and ``detrended``; add ``trend`` to invert."""
    s, y = spec.series_id, spec.target
    x = seconds(spec.date_col) / DAY
    base = df.withColumn("_x", x)
    fit = base.groupBy(s).agg(F.regr_slope(y, "_x").alias("_m"), F.regr_intercept(y, "_x").alias("_k"))
    out = null_safe_join(base, fit, [s]).withColumn("trend", F.col("_k") + F.col("_m") * F.col("_x"))
    return out.withColumn("detrended", F.col(y) - F.col("trend")).drop("_x", "_m", "_k")


def to_returns(bars: DataFrame, by: str = "symbol", order: str = "date") -> DataFrame:
    """Log returns close to close and open to close."""
    return windowed(
        bars, [by], [order],
        lambda w: {"ret_close": F.ln("close") - F.ln(F.lag("close").over(w)), "ret_open": F.ln("close") - F.ln("open")}, 1,
    )


def hour_ending_to_utc(df: DataFrame, day: str, label: str, tz: str = "America/New_York") -> DataFrame:
    """Local day + hour-ending label -> UTC instant of the hour's end.

    A spring day lacks label 3 and an autumn day has the extra label 02X, so hours are renumbered
    1..23 or 1..25 within the day and counted from local midnight.
    """
    order = F.when(F.col(label) == "02X", 2.5).otherwise(F.col(label).try_cast("double"))
    w = Window.partitionBy(day).orderBy("_o")  # at most 25 rows
    hours = F.row_number().over(w)
    midnight = F.to_utc_timestamp(F.col(day).cast("timestamp"), tz)
    d = df.withColumn("_o", order).withColumn("_h", hours)
    return d.withColumn("utc", F.timestamp_seconds(F.unix_seconds(midnight) + F.col("_h") * 3600)).drop("_o", "_h")


def quality_run(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """All table-level checks as ``check, value, passed``."""
    parts = [hierarchical_check(df, spec), negative_check(df, spec), edge_checks(df, spec), gap_check(df, spec)]
    dup = _check("duplicate_dates", duplicate_dates(df, spec).agg(F.count(F.lit(1)).alias("value")), F.col("value") == 0)
    low = _check("zero_inflated", df.agg(F.min(spec.target).alias("value")), F.col("value") != 0)
    out = dup.unionByName(low)
    for p in parts:
        out = out.unionByName(p)
    return out
