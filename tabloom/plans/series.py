"""Time-series operators."""

from pyspark.sql import functions as F

from tabloom.functions import metrics as M, scalars as S
from tabloom.operators import series as T
from tabloom.plans.aggregates import BRAND_DAY, brand_month, qcut_sql
from tabloom.plans.fixtures import V_BARS, V_CALENDAR, V_GAP, V_SERIES, V_ZERO
from tabloom.plans.registry import query
from tabloom.spec import SeriesSpec

SPEC = SeriesSpec()
MONTHLY = SeriesSpec("s", "d", "v")

ST = "st as (select *, (epoch(date) - epoch(lag(date) over (partition by series_id order by date)))::double as step from v_gap)"


@query(
    "T01_series_summary",
    f"""with {V_GAP}, {ST}, n as (select count(*) as n from st group by series_id) select count(*) as rows, 3 as cols, round(min(target), 6) as min_target, round(max(target), 6) as max_target,
    count(distinct series_id) as series, min(date) as start, max(date) as "end", min(step) as min_step, max(step) as max_step, (select min(n) from n) as min_length,
    (select max(n) from n) as max_length, (epoch(max(date)) - epoch(min(date))) / 86400 as span_days, median(step) as median_step from st""",
)
def t01(t):
    return T.series_summary(t.gap, SPEC)


@query("T01_series_lengths", f"with {V_GAP}, {ST} select series_id, count(*) as rows, min(date) as start, max(date) as \"end\", max(step) as max_step, max(step) / (select median(step) from st) as max_gap from st group by 1")
def t01b(t):
    return T.series_lengths(t.gap, SPEC)


@query("T02_infer_timestep", f"with {V_GAP}, {ST} select median(step) as median_step, 'day' as unit, (median(step) / 86400)::int as n from st")
def t02(t):
    return T.infer_timestep(t.gap, SPEC)


@query("T02_infer_timestep_month", f"with {BRAND_DAY}, st as (select (epoch(d) - epoch(lag(d) over (partition by s order by d)))::double as step from bd) select median(step) as median_step, 'month' as unit, 1 as n from st")
def t02b(t):
    return T.infer_timestep(brand_month(t), MONTHLY)


@query("T03_infer_season", f"with {V_GAP}, {ST} select min(step) as min_step, case when min(step) < 604800 then 7 else 52 end as season from st")
def t03(t):
    return T.infer_season(t.gap, SPEC)


@query("T04_pct_missing", "select round(avg((l_linenumber % 3 = 0 or l_quantity = 1)::int), 6) as missing from lineitem")
def t04(t):
    q = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    return T.pct_missing(t.lineitem.select(q.alias("q")), "q", 1.0)


@query("T05_zero_inflated", f"with {V_ZERO} select series_id, round(avg((target = 0)::int), 6) as zero_share from v_zero group by 1 having avg((target = 0)::int) >= 0.3")
def t05(t):
    return T.zero_inflated(t.zero, SPEC, 0.3)


@query("T05_drop_zero_inflated", f"with {V_ZERO} select series_id, date, round(target, 6) as target from v_zero where series_id not in (select series_id from v_zero group by 1 having avg((target = 0)::int) >= 0.3)")
def t05b(t):
    return T.drop_zero_inflated(t.zero, SPEC, 0.3)


@query("T06_time_steps", f"with {V_GAP}, {ST} select series_id, date, round(target, 6) as target, step / (select median(step) from st) as steps from st")
def t06(t):
    return T.time_steps(t.gap, SPEC)


@query(
    "T07_hierarchical_check",
    f"""with {V_GAP}, d as (select date, count(series_id) / (select count(distinct series_id) from v_gap) as share from v_gap group by 1)
    select 'hierarchical' as "check", round(avg((share > 0.95)::int), 6) as value, avg((share > 0.95)::int) > 0.95 as passed from d""",
)
def t07(t):
    return T.hierarchical_check(t.gap, SPEC)


def shifted(t):
    return t.series.withColumn("target", F.col("target") - F.length("series_id") * 900)


@query(
    "T08_negative_check",
    f"""with {V_SERIES}, n as (select series_id, bool_or(target - length(series_id) * 900 < 0) as b from v_series group by 1)
    select 'negative' as "check", round(avg(b::int), 6) as value, avg(b::int) = 0 as passed from n""",
)
def t08(t):
    return T.negative_check(shifted(t), SPEC)


CUST = "c as (select o_custkey as series_id, min(o_orderdate) as a, max(o_orderdate) as b from orders group by 1), e as (select min(a) as lo, max(b) as hi from c)"


@query(
    "T09_new_old_series",
    f"""with {CUST} select 'new_series' as "check", round(avg((a - lo > interval 30 day)::int), 6) as value, avg((a - lo > interval 30 day)::int) = 0 as passed from c, e
    union all select 'old_series', round(avg((hi - b > interval 30 day)::int), 6), avg((hi - b > interval 30 day)::int) = 0 from c, e""",
)
def t09(t):
    return T.edge_checks(t.orders, SeriesSpec("o_custkey", "o_orderdate", "o_totalprice"))


@query("T10_duplicate_dates", "select o_custkey, o_orderdate, count(*) as n from orders group by 1, 2 having count(*) > 1")
def t10(t):
    return T.duplicate_dates(t.orders, SeriesSpec("o_custkey", "o_orderdate", "o_totalprice"))


@query(
    "T11_gap_check",
    f"""with {V_GAP}, {ST}, g as (select series_id, max(step) > (select median(step) from st) as b from st group by 1)
    select 'gap' as "check", round(avg(b::int), 6) as value, avg(b::int) = 0 as passed from g""",
)
def t11(t):
    return T.gap_check(t.gap, SPEC)


FILLED = """span as (select series_id, min(date) as a, max(date) as b from v_gap group by 1),
    grid as (select series_id, unnest(generate_series(a, b, interval 1 day)) as date from span)"""


@query(
    "T12_irregular_check",
    f"""with {V_GAP}, {FILLED}, c as (select isodow(date) - 1 as bin, count(*) as n from v_gap group by 1), u as (select bin from c where n >= 0.3 * (select max(n) from c)),
    p as (select g.series_id, isodow(g.date) - 1 as bin, count(v.date) / count(*) as presence from grid g left join v_gap v on v.series_id = g.series_id and v.date = g.date group by 1, 2)
    select series_id, bin::int as bin, round(presence, 6) as presence from p where bin in (select bin from u) and presence < 0.8""",
)
def t12(t):
    out = T.irregular_series(t.gap, SPEC, "day")
    return out.fillna({"presence": 0.0})


def period_sql(part, name, expr):
    return f"""select '{part}' as part, '{name}' as period, max(z) as z from (select abs((m - first(m) over w) / sqrt(sum(ss) over () / (sum(n) over () - count(*) over ()) * (1 / n + 1 / first(n) over w))) as z,
      row_number() over w as r from (select cast({expr} as varchar) as level, count(*) as n, avg(target) as m, var_pop(target) * count(*) as ss from v_series group by 1) window w as (order by level)) where r > 1"""


@query(
    "T13_periodicity",
    f"""with {V_SERIES}, p as ({period_sql('dow', 'weekly', 'isodow(date) - 1')} union all {period_sql('dom', 'monthly', 'day(date)')})
    select part, period, round(z, 4) as max_z, z >= 1.959963984540054 as detected from p""",
    digits=4,
)
def t13(t):
    return T.periodicity(t.series, SPEC, "day").filter("part <> 'month'")


@query("T14_fill_dates", f"with {V_GAP}, {FILLED} select g.series_id, g.date, round(target, 6) as target from grid g left join v_gap v on v.series_id = g.series_id and v.date = g.date")
def t14(t):
    return T.fill_dates(t.gap, SPEC, "day")


TRIM = """e as (select series_id, min(date) filter (where target <> 0) as a, max(date) filter (where target <> 0) as b from v_zero group by 1),
    n as (select series_id, a, b, count(target) filter (where date < a) as lead, count(target) filter (where date > b) as trail from v_zero join e using (series_id) group by 1, 2, 3),
    o as (select v.*, a is null or (lead >= 5 and date < a) or (trail >= 5 and date > b) as gone from v_zero v join n using (series_id))"""


@query("T15_trim_zeros", f"with {V_ZERO}, {TRIM} select series_id, date, case when not gone then round(target, 6) end as target from o")
def t15(t):
    return T.trim_zeros(t.zero, SPEC)


@query("T15_drop_zeros", f"with {V_ZERO}, {TRIM} select series_id, date, round(target, 6) as target from o where not gone")
def t15b(t):
    return T.trim_zeros(t.zero, SPEC, drop=True)


@query(
    "T16_drop_gappy",
    f"""with {V_GAP}, {ST}, k as (select series_id from st group by 1 having max(step) <= 2 * (select median(step) from st))
    select series_id, date, round(target, 6) as target from v_gap where series_id in (select series_id from k)""",
)
def t16(t):
    return T.drop_gappy(t.gap, SPEC, 2)


@query(
    "T17_cross_series_features",
    f"""with {V_SERIES} select series_id, date, round(target, 5) as target, round(avg(target) over w, 5) as target_mean, round(max(target) over w, 5) as target_max,
    round(stddev_samp(target) over w, 5) as target_std from v_series window w as (partition by date)""",
    digits=5,
)
def t17(t):
    return T.cross_series_features(t.series, ["date"], ["target"], ["mean", "max", "std"])


@query(
    "T18_holiday_calendar",
    """with s as (select min(o_orderdate)::date as a, max(o_orderdate)::date + 365 as b from orders), d as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as d from s),
    x as (select d, month(d) as m, day(d) as dd, isodow(d) as w, (day(d) - 1) // 7 + 1 as k from d), y as (select unnest(range(1995, 2004)) as y),
    f(h, m, dd) as (values ('New Year''s Day', 1, 1), ('Veterans Day', 11, 11)),
    o as (select h, make_date(y, m, dd) as raw from f, y),
    r as (select h as "Event", case isodow(raw) when 6 then raw - 1 when 7 then raw + 1 else raw end as "Date" from o
      union all select 'Martin Luther King Jr. Day', d from x where m = 1 and w = 1 and k = 3 union all select 'Presidents Day', d from x where m = 2 and w = 1 and k = 3
      union all select 'Memorial Day', d from x where m = 5 and w = 1 and dd >= 25 union all select 'July 4th', d from x where m = 7 and dd = 4
      union all select 'Labor Day', d from x where m = 9 and w = 1 and k = 1 union all select 'Columbus Day', d from x where m = 10 and w = 1 and k = 2
      union all select 'Thanksgiving', d from x where m = 11 and w = 4 and k = 4 union all select 'Black Friday', d from x where m = 11 and w = 5 and dd between 23 and 29
      union all select 'Cyber Monday', d + 4 from x where m = 11 and w = 4 and k = 4 union all select 'Christmas', d from x where m = 12 and dd = 25)
    select "Date", "Event" from r, s where "Date" between a and b""",
)
def t18(t):
    return T.holiday_calendar(t.orders, "o_orderdate")


@query(
    "T19_events_on_series",
    f"""with {V_CALENDAR}, a as (select o_orderdate, avg(o_totalprice) as target from orders group by 1)
    select o_orderdate, round(target, 4) as target, date as event_date, event from a join v_calendar on date between o_orderdate and o_orderdate + interval 7 day""",
    digits=4,
)
def t19(t):
    return T.events_on_series(t.orders, SeriesSpec("o_custkey", "o_orderdate", "o_totalprice"), t.calendar, "week")


@query(
    "T20_event_distance",
    f"""with {V_CALENDAR} select o_orderkey, """
    + ", ".join(
        f"""(select min(date_diff('day', o_orderdate, date)) from v_calendar where date >= o_orderdate{c})::int as {n}_days_to, (select min(date_diff('day', date, o_orderdate)) from v_calendar where date <= o_orderdate{c})::int as {n}_days_since"""
        for n, c in (("any", ""), ("christmas", " and event = 'christmas'"), ("independence", " and event = 'independence'"))
    )
    + " from orders",
)
def t20(t):
    return T.event_distance_cols(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", t.calendar, ["christmas", "independence"]).drop("o_orderdate")


@query(
    "T21_sax",
    f"""with {V_SERIES}, q as (select series_id, quantile_cont(target, 0.2) as a, quantile_cont(target, 0.4) as b, quantile_cont(target, 0.6) as c, quantile_cont(target, 0.8) as d from v_series group by 1),
    l as (select series_id, date, target, chr(97 + (target > a)::int + (target > b)::int + (target > c)::int + (target > d)::int) as l from v_series join q using (series_id)),
    g as (select series_id, string_agg(l, '' order by date) as sax, count(*) as length, count(distinct target) as "distinct" from l group by 1)
    select *, """
    + ", ".join(f"round((length - len(replace(sax, '{x}', ''))) / length, 6) as pct_{x}" for x in "abcde")
    + " from g where length > 5",
)
def t21(t):
    return T.sax(t.series, SPEC)


@query("T22_pacf_features")
def t22(t):
    return T.pacf_features(brand_month(t), MONTHLY, 5)


def _levinson_sql(lags):
    """The recursion over the lags, one step a subquery."""
    q = "select s, n, " + ", ".join(f"c{i} / c0 as r{i}" for i in range(1, lags + 1)) + " from sums where c0 > 0"
    for k in range(1, lags + 1):
        before = [f"p{k - 1}_{j}" for j in range(1, k)]
        top = " - ".join([f"r{k}", *[f"{p} * r{k - j}" for j, p in enumerate(before, 1)]])
        low = " - ".join(["1", *[f"{p} * r{j}" for j, p in enumerate(before, 1)]])
        q = f"select *, ({top}) / ({low}) as p{k}_{k} from ({q})"
        if before:
            q = f"select *, {', '.join(f'p{k - 1}_{j} - p{k}_{k} * p{k - 1}_{k - j} as p{k}_{j}' for j in range(1, k))} from ({q})"
    return q


@query(
    "T22_pacf_levinson",
    f"""with {BRAND_DAY}, x as (select s, d, v - avg(v) over (partition by s) as x from bd where v is not null), l as (select s, x, {", ".join(f"lag(x, {i}) over (partition by s order by d) as x{i}" for i in range(1, 6))} from x),
    sums as (select s, count(*) as n, sum(x * x) as c0, {", ".join(f"coalesce(sum(x * x{i}), 0) as c{i}" for i in range(1, 6))} from l group by 1)
    select s, {", ".join(f"case when {k} > floor((n - 1) / 2) then 'NaN'::double when abs(p{k}_{k}) > 1.959963984540054 / sqrt(n) then round(p{k}_{k}, 6) else 0 end as pacf_{k}" for k in range(1, 6))} from ({_levinson_sql(5)})""",
)
def t22b(t):
    return T.pacf_features(brand_month(t), MONTHLY, 5, method="levinson")


@query("T23_series_distance", f"with {BRAND_DAY} select a.s as series_1, b.s as series_2, count(*) as n, round(corr(a.v, b.v), 6) as corr from bd a join bd b on a.d = b.d and a.s < b.s group by 1, 2")
def t23(t):
    return T.series_distance(brand_month(t), MONTHLY)


@query("T23_pacf_distance")
def t23b(t):
    return T.series_distance(brand_month(t), MONTHLY, "pacf", 5)


@query(
    "T24_split_series",
    f"""with {BRAND_DAY}, m as (select s, avg(v) as m from bd group by 1), b as (select s, {qcut_sql('m', 'm', 4)} as b from m)
    select s, dense_rank() over (order by b) as cluster from b""",
)
def t24(t):
    return T.split_series(brand_month(t), MONTHLY, "quantile", 4).select("s", "cluster").distinct()


@query(
    "T24_split_series_width",
    f"""with {BRAND_DAY}, m as (select s, avg(v) as m from bd group by 1), r as (select min(m) as lo, max(m) as hi from m), b as (select s, least(4, greatest(1, ceil((m - lo) / ((hi - lo) / 4)))) as b from m, r)
    select s, dense_rank() over (order by b) as cluster from b""",
)
def t24b(t):
    return T.split_series(brand_month(t), MONTHLY, "width", 4).select("s", "cluster").distinct()


@query("T25_cluster_series")
def t25(t):
    return T.cluster_series(brand_month(t), MONTHLY, "pacf", None, 4, 5)


@query(
    "T25_cluster_distances",
    f"""with {BRAND_DAY} select s, 3 as clusters, true as nearest, true as medoid_is_own from (select distinct s from bd)""",
)
def t25b(t):
    """Three medoids: every series is with the nearest, and a medoid with itself; distances are compared with all correlations."""
    rows = brand_month(t)
    c = T.distance_clusters(rows, MONTHLY, k=3)
    pairs = T.series_distance(rows, MONTHLY)
    both = pairs.select(F.col("series_1").alias("s"), F.col("series_2").alias("m"), "corr").unionByName(pairs.select(F.col("series_2").alias("s"), F.col("series_1").alias("m"), "corr"))
    mids = c.select(F.col("medoid").alias("m")).distinct()
    all_ = c.crossJoin(F.broadcast(mids)).join(both, ["s", "m"], "left").withColumn("d", F.when(F.col("s") == F.col("m"), 0.0).otherwise(F.coalesce(1 - F.col("corr"), F.lit(2.0))))
    size = c.agg(F.count_distinct("medoid").cast("int").alias("clusters"))
    g = all_.groupBy("s", "medoid").agg((F.max("distance") <= F.min("d") + 1e-9).alias("nearest"), F.max(F.when(F.col("m") == F.col("s"), F.col("m"))).alias("self"))
    return g.crossJoin(F.broadcast(size)).select("s", "clusters", "nearest", (F.col("self").isNull() | (F.col("self") == F.col("medoid"))).alias("medoid_is_own"))


LAGGED = "p as (select series_id, date, target as y, lag(target) over (partition by series_id order by date) as p from v_series)"


@query(
    "T26_accuracy_by",
    f"""with {V_SERIES}, {LAGGED} select series_id, round(sqrt(avg((y - p) ** 2)), 5) as rmse, round(avg(abs(y - p)), 5) as mae, round(avg(abs(p - y) / ((abs(y) + abs(p)) / 2)), 5) as smape
    from p group by grouping sets ((series_id), ())""",
    digits=5,
)
def t26(t):
    from tabloom.operators.windows import lag_lead

    d = lag_lead(t.series, ["series_id"], "date", "target", [1])
    y, p = F.col("target"), F.col("target_lag_1")
    return T.accuracy_by(d, ["series_id"], {"rmse": M.rmse(y, p), "mae": M.mae(y, p), "smape": M.smape(y, p)})


@query(
    "T27_merge_preds_actuals",
    f"with {V_SERIES}, {V_GAP.replace(V_SERIES + ', ', '')} select s.series_id, s.date, round(s.target * 1.1, 6) as prediction, round(g.target, 6) as target from v_series s left join v_gap g on s.series_id = g.series_id and s.date = g.date",
)
def t27(t):
    preds = t.series.select("series_id", "date", (F.col("target") * F.lit(1.1)).alias("prediction"))
    return T.merge_preds_actuals(preds, t.gap, ["series_id", "date"])


@query(
    "T28_forecast_baselines",
    f"""with {V_SERIES}, p as (select series_id, target, row_number() over w as r, count(*) over (partition by series_id) as n from v_series window w as (partition by series_id order by date)),
    g as (select series_id, max(n) as n, avg(target) as mean, max(target) filter (where r = 1) as f, max(target) filter (where r = n) as l from p group by 1), h as (select unnest(range(1, 11))::int as h)
    select g.series_id, h, round(mean, 5) as mean, round(l + h * (l - f) / (g.n - 1), 5) as drift, round(p.target, 5) as snaive from g, h join p on p.series_id = g.series_id and p.r = g.n - 7 + (h - 1) % 7 + 1""",
    digits=5,
)
def t28(t):
    return T.forecast_baselines(t.series, SPEC, 10, 7)


@query("T28_exponential_smoothing")
def t28b(t):
    return T.exponential_smoothing(t.series, SPEC)


@query(
    "T29_detrend",
    f"""with {V_SERIES}, x as (select *, epoch(date) / 86400 as x from v_series), f as (select series_id, regr_slope(target, x) as m, regr_intercept(target, x) as k from x group by 1)
    select series_id, date, round(target, 4) as target, round(k + m * x, 4) as trend, round(target - k - m * x, 4) + 0 as detrended from x join f using (series_id)""",
    digits=4,
)
def t29(t):
    return T.detrend(t.series, SPEC)


@query(
    "T30_to_returns",
    f"with {V_BARS} select symbol, date, round(ln(close) - ln(lag(close) over (partition by symbol order by date)), 6) + 0 as ret_close, round(ln(close) - ln(open), 6) + 0 as ret_open from v_bars",
)
def t30(t):
    return T.to_returns(t.bars).select("symbol", "date", "ret_close", "ret_open")


@query(
    "T31_hour_ending_to_utc",
    """with d as (select distinct o_orderdate as d from orders), k as (select d, case when isodow(d) = 7 and month(d) = 4 and day(d) <= 7 then 23 when isodow(d) = 7 and month(d) = 10 and day(d) >= 25 then 25 else 24 end as n,
      case when (month(d) = 4 and d <= date_trunc('month', d) + to_days(((7 - isodow(date_trunc('month', d))) % 7)::int)) or month(d) < 4 or month(d) > 10
        or (month(d) = 10 and d > last_day(d) - to_days((isodow(last_day(d)) % 7)::int)) then 5 else 4 end as off from d), h as (select d, off, n, unnest(range(1, n + 1)) as i from k)
    select d, case when n = 24 then lpad(i::varchar, 2, '0') when n = 23 then lpad((i + (i >= 3)::int)::varchar, 2, '0') when i = 3 then '02X' else lpad((i - (i > 3)::int)::varchar, 2, '0') end as he,
      d + to_hours(off + i) as utc from h""",
)
def t31(t):
    d = t.orders.select(F.col("o_orderdate").alias("d")).distinct()
    sunday = F.weekday("d") == 6
    spring = sunday & (F.month("d") == 4) & (F.dayofmonth("d") <= 7)
    autumn = sunday & (F.month("d") == 10) & (F.dayofmonth("d") >= 25)
    labels = [f"{i:02d}" for i in range(1, 25)]

    def arr(x):
        return F.array(*[F.lit(v) for v in x])

    he = F.when(spring, arr([v for v in labels if v != "03"])).when(autumn, arr([*labels[:2], "02X", *labels[2:]])).otherwise(arr(labels))
    return T.hour_ending_to_utc(d.withColumn("he", F.explode(he)), "d", "he")


@query("T32_corr_clusters")
def t32(t):
    return T.corr_clusters(brand_month(t), MONTHLY, [0.6, 0.4, 0.2])


@query("T00_quality_run", f"""with {V_GAP}, {ST}, d as (select date, count(series_id) / (select count(distinct series_id) from v_gap) as share from v_gap group by 1),
    g as (select series_id, max(step) > (select median(step) from st) as b, bool_or(target < 0) as neg, min(date) as a, max(date) as z from st group by 1)
    select 'hierarchical' as "check", round(avg((share > 0.95)::int), 6) as value, avg((share > 0.95)::int) > 0.95 as passed from d
    union all select 'gap', round(avg(b::int), 6), avg(b::int) = 0 from g union all select 'negative', avg(neg::int), avg(neg::int) = 0 from g
    union all select 'new_series', avg((a > (select min(a) from g) + interval 30 day)::int), true from g union all select 'old_series', avg((z < (select max(z) from g) - interval 30 day)::int), true from g
    union all select 'duplicate_dates', 0, true union all select 'zero_inflated', round(min(target), 6), min(target) <> 0 from v_gap""")
def t00(t):
    return T.quality_run(t.gap, SPEC)


@query(
    "T28_exponential_smoothing_sql",
    f"""with recursive {V_SERIES}, y as (select series_id, target as y, row_number() over (partition by series_id order by date) as r from v_series), a as (select (i / 10.0)::double as alpha from (select unnest(range(1, 10)) as i)),
    l(series_id, alpha, r, level, err) as (select series_id, alpha, r, y, null::double from y, a where r = 1 union all select l.series_id, l.alpha, y.r, l.alpha * y.y + (1 - l.alpha) * l.level, y.y - l.level from l join y on y.series_id = l.series_id and y.r = l.r + 1),
    g as (select series_id, alpha, avg(err * err) as mse, arg_max(level, r) as forecast from l group by 1, 2)
    select series_id, alpha, round(mse, 4) as mse, round(forecast, 4) as forecast from g qualify row_number() over (partition by series_id order by mse, alpha) = 1""",
    digits=4,
)
def t28c(t):
    return T.exponential_smoothing(t.series, SPEC)
