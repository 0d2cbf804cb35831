"""Window operators."""

from pyspark.sql import functions as F

from tabloom.operators import order as O, reshape as R, windows as W
from tabloom.plans.fixtures import V_BARS, V_GAP, V_HISTORY, V_SERIES, V_TRIPLES
from tabloom.plans.registry import query

SER = "partition by series_id order by date"


@query(
    "W01_lag_lead",
    f"""with {V_SERIES} select series_id, date, round(target, 6) as target, round(lag(target, 1) over w, 6) as target_lag_1,
    round(lag(target, 7) over w, 6) as target_lag_7, round(lead(target, 2) over w, 6) as target_lead_2 from v_series window w as ({SER})""",
)
def w01(t):
    return W.lag_lead(t.series, ["series_id"], "date", "target", [1, 7, -2])


@query(
    "W02_rolling_mean_std",
    f"""with {V_SERIES} select series_id, date, round(target, 6) as target,
    case when count(*) over w = 5 then round(avg(target) over w, 6) end as target_mean_5, case when count(*) over w = 5 then round(stddev_samp(target) over w, 6) end as target_std_5
    from v_series window w as ({SER} rows between 4 preceding and current row)""",
)
def w02(t):
    return W.rolling(t.series, ["series_id"], "date", "target", 5)


@query(
    "W03_change",
    f"""with {V_GAP} select series_id, date, round(target, 6) as target, round(target - lag(target) over w, 6) as target_diff,
    round(target / lag(target) over w - 1, 6) as target_pct, epoch(date) - epoch(lag(date) over w) as step_seconds from v_gap window w as ({SER})""",
)
def w03(t):
    return W.changes(t.gap, ["series_id"], "date", "target")


@query(
    "W04_lag_stats",
    f"with {V_SERIES} select series_id, date, round(target, 6) as target, "
    + ", ".join(
        f"""case when count(*) over w{n} = {n} then round(avg(target) over w{n}, 6) end as mean_{n}, case when count(*) over w{n} = {n} then round(min(target) over w{n}, 6) end as min_{n},
        case when count(*) over w{n} = {n} then round(max(target) over w{n}, 6) end as max_{n}, case when count(*) over w{n} = {n} then round(median(target) over w{n}, 6) end as median_{n},
        case when count(*) over w{n} = {n} then round(ln(avg(target) filter (where target <> 0) over w{n}), 6) end as ln_nonzero_{n}"""
        for n in (3, 6)
    )
    + f" from v_series window w3 as ({SER} rows between 2 preceding and current row), w6 as ({SER} rows between 5 preceding and current row)",
)
def w04(t):
    return W.lag_stats(t.series, ["series_id"], "date", "target", [3, 6])


LINES = """lines as (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey
    order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) as pos from lineitem)"""
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query(
    "W05_rolling_mode",
    f"""with {LINES}, c as (select a.l_suppkey, a.pos, b.l_quantity, count(*) as n from lines a
      join lines b on a.l_suppkey = b.l_suppkey and b.pos between a.pos - 9 and a.pos group by 1, 2, 3)
    select l_suppkey, pos, l_quantity as mode from c qualify row_number() over (partition by l_suppkey, pos order by n desc, l_quantity) = 1""",
)
def w05(t):
    lines = t.lineitem.select("l_suppkey", *LINE_ORDER)
    at = O.row_positions(lines, LINE_ORDER, ["l_suppkey"], even=O.even_keys(lines, ["l_suppkey"]))
    return W.rolling_mode(at.select("l_suppkey", "pos", "l_quantity"), ["l_suppkey"], ["pos"], "l_quantity", 10).select("l_suppkey", "pos", "mode")


@query(
    "W06_group_transform",
    """select o_orderkey, round(avg(o_totalprice) over w, 4) as mean, round(stddev_samp(o_totalprice) over w, 4) as sd, max(o_totalprice) over w as top,
    min(o_orderdate) over w as first from orders window w as (partition by o_orderpriority)""",
    digits=4,
)
def w06(t):
    p = "o_totalprice"
    out = O.group_transform(t.orders, ["o_orderpriority"], {"mean": F.avg(p), "sd": F.stddev_samp(p), "top": F.max(p), "first": F.min("o_orderdate")})
    return out.select("o_orderkey", "mean", "sd", "top", "first")


@query(
    "W07_running_mean",
    f"""with {V_SERIES} select series_id, date, round(sum(target) over w, 4) as cum_sum, round(avg(target) over w, 4) as cum_mean,
    round(avg(target) over (w2 rows between unbounded preceding and 1 preceding), 4) as prior_mean
    from v_series window w as ({SER} rows unbounded preceding), w2 as ({SER})""",
    digits=4,
)
def w07(t):
    return W.running(t.series, ["series_id"], "date", "target")


@query("W08_dense_rank", "select o_orderkey, dense_rank() over (partition by o_custkey order by o_orderdate) as rank from orders")
def w08(t):
    return W.dense_rank(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_orderkey", "rank")


@query(
    "W09_last_k_items",
    f"""with {V_HISTORY}, h as (select distinct cust_id, dt, size from v_history), d as (select distinct cust_id, dt from h),
    p as (select d.cust_id, d.dt, h.size, row_number() over (partition by d.cust_id, d.dt order by h.dt desc, h.size) as r
      from d join h on h.cust_id = d.cust_id and h.dt < d.dt)
    select d.cust_id, d.dt, """
    + ", ".join(f"max(size) filter (where r = {i}) as L{i}" for i in range(1, 9))
    + """, coalesce(string_agg(size, ' ' order by r) filter (where r <= 5), '') as last_5 from d left join p using (cust_id, dt) group by 1, 2""",
)
def w09(t):
    return W.last_k_items(t.history, ["cust_id"], "dt", "size", k=8)


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "W10_history_counts",
    f"""with {V_HISTORY}, d as (select cust_id, dt, {", ".join(f"count(*) filter (where size = '{b}') as n{i}" for i, b in enumerate(BRANDS))} from v_history group by 1, 2)
    select cust_id, dt, {", ".join(f'coalesce(sum(n{i}) over w, 0)::bigint as "n_{b}"' for i, b in enumerate(BRANDS))}
    from d window w as (partition by cust_id order by dt rows between unbounded preceding and 1 preceding)""",
)
def w10(t):
    return W.history_counts(t.history, ["cust_id"], "dt", "size", BRANDS)


@query(
    "W11_prefix_sum",
    """with d as (select l_extendedprice, sum(l_quantity) as q, count(*) as n from lineitem group by 1)
    select l_extendedprice, q, n, sum(q) over (order by l_extendedprice) as cum_q, sum(n) over (order by l_extendedprice)::bigint as cum_n from d""",
)
def w11(t):
    return O.prefix_sum(t.lineitem, "l_extendedprice", {"q": F.col("l_quantity"), "n": F.lit(1)})


@query(
    "W12_keep_first_row",
    """select p_brand, p_name, p_partkey from part qualify row_number() over (partition by p_brand order by length(p_name) desc, p_name desc, p_partkey desc) = 1""",
)
def w12(t):
    order = [F.length("p_name"), F.col("p_name"), F.col("p_partkey")]
    return R.best_row(t.part, ["p_brand"], order, ["p_name", "p_partkey"])


@query(
    "W13_ranks",
    """select o_orderkey, rank() over w as rank_min, dense_rank() over w as rank_dense, rank() over w + (count(*) over p - 1) as rank_max,
    (rank() over w + (count(*) over p - 1) / 2)::double as rank_avg
    from orders window w as (partition by o_orderstatus order by o_orderdate), p as (partition by o_orderstatus, o_orderdate)""",
)
def w13(t):
    r = O.ranks(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", ["o_orderstatus"])
    return r.select("o_orderkey", "rank_min", "rank_avg", "rank_max", "rank_dense")


HOLED = """holed as (select series_id, date, case when day(date) % 4 = 0 or day(date) % 4 = length(series_id) % 4 then null else target end as y from v_series)"""


@query(
    "W14_fills",
    f"""with {V_SERIES}, {HOLED}, f as (select *, last_value(y ignore nulls) over (w rows unbounded preceding) as b, first_value(y ignore nulls) over (w rows between current row and unbounded following) as a,
      last_value(case when y is not null then epoch(date) end ignore nulls) over (w rows unbounded preceding) as tb,
      first_value(case when y is not null then epoch(date) end ignore nulls) over (w rows between current row and unbounded following) as ta from holed window w as ({SER}))
    select series_id, date, round(y, 6) as y, round(b, 6) as y_ffill, round(a, 6) as y_bfill, round(coalesce(y, b + (a - b) / (ta - tb) * (epoch(date) - tb)), 6) as y_interp from f""",
)
def w14(t):
    d = F.dayofmonth("date") % 4
    y = F.when((d == 0) | (d == F.length("series_id") % 4), None).otherwise(F.col("target"))
    return W.fills(t.series.select("series_id", "date", y.alias("y")), ["series_id"], "date", "y")


@query(
    "W15_cumcount",
    """select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth, count(*) over (partition by o_custkey) as total,
    case when row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) % 2 = 1 then 'odd' else 'even' end as state from orders""",
)
def w15(t):
    return W.cumcount(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "nth", "total", "state"
    )


@query(
    "W16_tenure",
    """with known as (select o_custkey, min(o_orderdate) as first from orders where o_orderstatus <> 'O' group by 1),
    new as (select * from orders where o_orderstatus = 'O'),
    f as (select o_custkey, min(first) as first from (select * from known union all select o_custkey, min(o_orderdate) from new group by 1) group by 1)
    select o_orderkey, first, date_diff('day', first, o_orderdate)::int as tenure_days from new join f using (o_custkey)""",
)
def w16(t):
    known = t.orders.filter("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    new = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    return W.tenure(new, "o_custkey", "o_orderdate", known).select("o_orderkey", "first", "tenure_days")


@query(
    "W17_prior_outcomes",
    """with d as (select o_custkey, o_orderdate, sum((o_orderstatus = 'F')::int) as w from orders group by 1, 2)
    select o_custkey, o_orderdate, coalesce(sum(w) over v, 0)::bigint as times_won_before, coalesce(sum(w) over v, 0) > 0 as won_before
    from d window v as (partition by o_custkey order by o_orderdate rows between unbounded preceding and 1 preceding)""",
)
def w17(t):
    return W.prior_outcomes(t.orders, ["o_custkey"], "o_orderdate", F.col("o_orderstatus") == "F")


B = "partition by symbol order by date"


def frame(expr, n):
    return f"case when count(*) over (w rows {n - 1} preceding) = {n} then {expr.replace('FRAME', f'over (w rows {n - 1} preceding)')} end"


IND = f"""lb as (select symbol, date, ln(open) as open, ln(high) as high, ln(low) as low, ln(close) as close, volume from v_bars),
    b as (select *, (high + low + close) / 3 as tp, close - lag(close) over w as d, lag(close) over w as pc, row_number() over w as rn,
      coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) as clv from lb window w as ({B})),
    c as (select *, tp - lag(tp) over w as tpd from b window w as ({B})),
    m as (select a.symbol, a.date, avg(abs(x.tp - a.m20)) as md from (select symbol, date, rn, avg(tp) over (w rows 19 preceding) as m20 from c window w as ({B})) a
      join c x on x.symbol = a.symbol and x.rn between a.rn - 19 and a.rn group by 1, 2),
    ar as (select a.symbol, a.date, min(a.rn - x.rn) filter (where x.high = a.hh) as ah, min(a.rn - x.rn) filter (where x.low = a.ll) as al
      from (select symbol, date, rn, max(high) over (w rows 20 preceding) as hh, min(low) over (w rows 20 preceding) as ll from c window w as ({B})) a
      join c x on x.symbol = a.symbol and x.rn between a.rn - 20 and a.rn group by 1, 2),
    wm as (select a.symbol, a.date, sum(x.close * (10 - (a.rn - x.rn))) / 55 as wma from c a join c x on x.symbol = a.symbol and x.rn between a.rn - 9 and a.rn group by 1, 2)"""


@query(
    "W18_indicators",
    f"""with {V_BARS}, {IND} select symbol, date, round(clv, 6) as clv, round(greatest(high, coalesce(pc, high)) - least(low, coalesce(pc, low)), 6) as tr, round(d, 6) as momentum,
    round({frame('avg(close) FRAME', 10)}, 6) as sma, round(close - {frame('avg(close) FRAME', 10)}, 6) as dpo, case when rn >= 10 then round(wma, 6) end as wma,
    round((close - {frame('min(low) FRAME', 14)}) / nullif({frame('max(high) FRAME', 14)} - {frame('min(low) FRAME', 14)}, 0), 6) as fast_k,
    round(({frame('max(high) FRAME', 14)} - close) / nullif({frame('max(high) FRAME', 14)} - {frame('min(low) FRAME', 14)}, 0), 6) as wpr,
    case when rn > 14 then round(100 * sum(d) over (w rows 13 preceding) / nullif(sum(abs(d)) over (w rows 13 preceding), 0), 6) end as cmo,
    case when rn > 14 then round(100 - 100 / (1 + sum(case when tpd > 0 then tp * volume else 0 end) over (w rows 13 preceding)
      / nullif(sum(case when tpd < 0 then tp * volume else 0 end) over (w rows 13 preceding), 0)), 6) end as mfi,
    case when rn > 28 then round((max(close) over (w rows 27 preceding) - min(close) over (w rows 27 preceding)) / nullif(sum(abs(d)) over (w rows 27 preceding), 0), 6) end as vhf,
    round((tp - {frame('avg(tp) FRAME', 20)} + 2 * {frame('stddev_pop(tp) FRAME', 20)}) / nullif(4 * {frame('stddev_pop(tp) FRAME', 20)}, 0), 6) as bb_pct,
    case when rn >= 20 then round((tp - avg(tp) over (w rows 19 preceding)) / nullif(0.015 * md, 0), 6) end as cci,
    case when rn >= 21 then 100 * (20 - ah) / 20 end as aroon_up, case when rn >= 21 then 100 * (20 - al) / 20 end as aroon_down, """
    + ", ".join(f"round({frame('sum(clv * volume) FRAME', n)} / {frame('sum(volume) FRAME', n)}, 6) as cmf_{n}" for n in range(1, 8))
    + f" from c join m using (symbol, date) join ar using (symbol, date) join wm using (symbol, date) window w as ({B})",
    digits=6,
)
def w18(t):
    return W.indicators(t.bars.withColumns({c: F.ln(c) for c in ("open", "high", "low", "close")}))


@query(
    "W19_ema",
    f"""with recursive {V_BARS}, b as (select symbol, date, close, row_number() over ({B}) as rn from v_bars),
    e(symbol, rn, y) as (select symbol, 10::bigint, avg(close) from b where rn <= 10 group by 1
      union all select b.symbol, b.rn, 2 / 11 * b.close + 9 / 11 * e.y from e join b on b.symbol = e.symbol and b.rn = e.rn + 1)
    select b.symbol, b.date, round(y, 6) as ema from b left join e using (symbol, rn)""",
)
def w19(t):
    return W.smooth(t.bars.select("symbol", "date", "close"), ["symbol"], "date", "close", 10, "ema").drop("close")


@query("W19_recursive_indicators")
def w19b(t):
    return W.recursive_indicators(t.bars).join(W.parabolic_sar(t.bars), ["symbol", "date"])


@query(
    "W20_lag_vector_fit",
    f"""with {V_BARS}, d as (select symbol, date, ln(close) as c, row_number() over ({B}) as rn from v_bars),
    p as (select a.symbol, a.date, a.rn, a.rn - x.rn as k, a.c - x.c as y from d a join d x on x.symbol = a.symbol and a.rn - x.rn between 1 and 14 where a.rn > 14),
    f as (select symbol, date, regr_slope(y, k) filter (where k <= 7) as slope, regr_intercept(y, k) filter (where k <= 7) as intercept, stddev_samp(y) as sd from p group by 1, 2)
    select d.symbol, d.date, round(c, 6) as c, round(slope, 6) + 0 as slope, round(sd, 6) as sd, round(intercept, 6) + 0 as intercept, round(intercept + slope * 8, 6) + 0 as pred,
      round((intercept + slope * 8) / sd, 6) + 0 as pred_adj from d left join f using (symbol, date)""",
)
def w20(t):
    return W.lag_vector_fit(t.bars.select("symbol", "date", F.ln("close").alias("c")), ["symbol"], "date", "c", 7)


@query(
    "W21_gap_profile",
    """with d as (select distinct o_custkey, o_orderdate from orders), g as (select o_custkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate), o_orderdate)::int as gap from d),
    n as (select * from g where gap is not null), s as (select avg((k > 2)::int) as irregular_share from (select o_custkey, count(distinct gap) as k from n group by 1))
    select gap, count(*) as n, round(count(*) / (select count(*) from n), 6) as share, (select round(irregular_share, 6) from s) as irregular_share from n group by 1""",
)
def w21(t):
    return W.gap_profile(t.orders, "o_custkey", "o_orderdate")


@query(
    "W22_win_rate",
    f"""with {V_TRIPLES}, r as (select *, rank() over (partition by project order by score desc) as rk, max(score) over (partition by project) - score as gap from v_triples)
    select item, count(*) filter (where rk = 1) as wins, round(avg(gap), 6) as mean_gap, count(*) as entries,
    round(count(*) filter (where rk = 1) / (select count(distinct project) from r), 6) as win_rate from r group by 1""",
)
def w22(t):
    return W.win_rate(t.triples, ["project"], "item", "score")
