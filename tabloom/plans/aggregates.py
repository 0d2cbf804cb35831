"""Aggregations and reshaping."""

from pyspark.sql import functions as F

from tabloom.operators import order as O, reshape as R
from tabloom.plans.fixtures import V_RUNS, V_SCORES, V_SERIES, V_TRIPLES
from tabloom.plans.registry import query
from tabloom.session import dealt, materialize, shuffled


def N():
    return F.count(F.lit(1))


@query(
    "A01_group_sum",
    "select l_partkey, l_suppkey, sum(l_quantity) as l_quantity from lineitem group by 1, 2",
)
def a01(t):
    return R.sum_rest(t.lineitem, ["l_partkey", "l_suppkey"], "l_quantity")


@query(
    "A02_multi_measure",
    """select l_returnflag, l_linestatus, max(l_quantity) as max_q, min(l_extendedprice) as min_p, round(avg(l_discount), 6) as avg_d,
    round(stddev_samp(l_quantity), 6) as sd_q, count(*) as n from lineitem group by 1, 2""",
)
def a02(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.max("l_quantity").alias("max_q"), F.min("l_extendedprice").alias("min_p"), F.avg("l_discount").alias("avg_d"),
        F.stddev_samp("l_quantity").alias("sd_q"), N().alias("n"),
    )


@query("A03_distinct_count", "select o_orderstatus, count(distinct o_custkey) as customers from orders group by 1")
def a03(t):
    """Exact distinct in two partial steps: no group's values meet in one task."""
    return t.orders.select("o_orderstatus", "o_custkey").distinct().groupBy("o_orderstatus").agg(N().alias("customers"))


@query("A04_filtered_share", "select l_returnflag, round(avg((l_discount = 0)::int), 6) as zero_share, count(*) filter (where l_tax > 0.05) as n from lineitem group by 1")
def a04(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.avg((F.col("l_discount") == 0).cast("int")).alias("zero_share"), F.count_if(F.col("l_tax") > 0.05).alias("n")
    )


@query(
    "A05_value_counts",
    " union all ".join(
        f"select '{c}' as \"column\", {c} as value, count(*) as n, round(count(*) / (select count(*) from orders), 6) as share from orders group by 2"
        for c in ("o_orderstatus", "o_orderpriority")
    ),
)
def a05(t):
    return R.value_counts(t.orders, ["o_orderstatus", "o_orderpriority"], normalize=True)


@query(
    "A06_mode",
    """with c as (select l_suppkey, l_quantity, count(*) as n from lineitem group by 1, 2)
    select l_suppkey, l_quantity as mode, n from c qualify row_number() over (partition by l_suppkey order by n desc, l_quantity) = 1""",
)
def a06(t):
    return R.mode_by(t.lineitem, ["l_suppkey"], "l_quantity")


@query(
    "A07_argmax_row",
    """select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) = 1""",
)
def a07(t):
    return R.best_row(t.orders, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("A08_collect_list", "select n_regionkey, string_agg(n_name, ',' order by n_name) as nations from nation group by 1")
def a08(t):
    out = R.collect_sorted(t.nation, ["n_regionkey"], "n_name")
    return out.select("n_regionkey", F.array_join("items", ",").alias("nations"))


@query(
    "A08_list_positions",
    "select o_orderstatus, o_orderdate, row_number() over (partition by o_orderstatus order by o_orderdate) as pos from (select distinct o_orderstatus, o_orderdate from orders)",
)
def a08b(t):
    return R.positions_by(t.orders, ["o_orderstatus"], "o_orderdate")


@query(
    "A09_pivot",
    """select o_custkey, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O,
    count(*) filter (where o_orderstatus = 'P') as P from orders group by 1""",
)
def a09(t):
    return R.pivot(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], {"n": N()}, fill=0)


@query(
    "A10_unpivot",
    """select event_id, 'value' as variable, value from events union all select event_id, 'k', (props::json ->> '$.k')::double from events
    where (props::json ->> '$.k')::double > 50""",
)
def a10(t):
    k = F.get_json_object("props", "$.k").cast("double")
    return R.melt(t.events.select("event_id", "value", F.when(k > 50, k).alias("k")), ["event_id"], ["value", "k"])


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
A11_CELLS = ", ".join(f"count(*) filter (where p_type = '{x}') as {x.lower()}_n, count(distinct p_name) filter (where p_type = '{x}') as {x.lower()}_names" for x in PART_TYPES)


@query("A11_crosstab", f"select p_brand, {A11_CELLS} from part group by 1")
def a11(t):
    cells = t.part.groupBy("p_brand", "p_type", "p_name").agg(N().alias("k"))
    out = R.pivot(cells, ["p_brand"], "p_type", list(PART_TYPES), {"n": F.sum("k"), "names": N()}, fill=0)
    return out.toDF("p_brand", *(f"{x.lower()}_{m}" for x in PART_TYPES for m in ("n", "names")))


@query(
    "A12_group_and_total",
    """select l_returnflag, round(avg(l_quantity), 6) as q, count(*) as n, (select round(avg(l_quantity), 6) from lineitem) as q_total,
    (select count(*) from lineitem) as n_total from lineitem group by 1""",
)
def a12(t):
    return R.with_grand_total(t.lineitem, ["l_returnflag"], {"q": F.avg("l_quantity"), "n": N()})


@query(
    "A12_rollup_cube",
    """select 'rollup' as kind, l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)
    union all select 'cube', l_returnflag, l_linestatus, count(*) from lineitem group by cube (l_returnflag, l_linestatus)""",
)
def a12b(t):
    k = ["l_returnflag", "l_linestatus"]
    r = t.lineitem.rollup(*k).agg(N().alias("n")).select(F.lit("rollup").alias("kind"), *k, "n")
    return r.unionByName(t.lineitem.cube(*k).agg(N().alias("n")).select(F.lit("cube").alias("kind"), *k, "n"))


BRAND_DAY = """bd as (select p_brand as s, date_trunc('month', l_shipdate)::timestamp as d, sum(l_quantity) as v
    from lineitem join part on p_partkey = l_partkey group by 1, 2)"""


def brand_month(t):
    """Months of a brand, written once: its readers go over it many times."""
    lines = dealt(t.lineitem, t.lineitem.count(), "l_partkey")
    j = lines.join(shuffled(t.part), F.col("p_partkey") == F.col("l_partkey"))
    return materialize(j.groupBy(F.col("p_brand").alias("s"), F.date_trunc("month", "l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v")))


@query(
    "A13_pairwise_correlation",
    f"""with {BRAND_DAY} select a.s as series_1, b.s as series_2, count(*) as n, round(corr(a.v, b.v), 6) as corr
    from bd a join bd b on a.d = b.d and a.s < b.s group by 1, 2""",
)
def a13(t):
    return R.pairwise_correlation(brand_month(t), "s", "d", "v")


@query(
    "A14_group_correlation",
    "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as c_price, round(corr(l_quantity, l_tax), 6) as c_tax from lineitem group by 1",
)
def a14(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.corr("l_quantity", "l_extendedprice").alias("c_price"), F.corr("l_quantity", "l_tax").alias("c_tax")
    )


@query(
    "A14_target_correlation",
    " union all ".join(
        f"select '{c}' as \"column\", round(corr({c}, l_extendedprice), 6) as corr from lineitem" for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def a14b(t):
    return R.target_correlation(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query(
    "A15_weighted_mean_std",
    f"""with {V_SCORES} select grp, round(sum(w * p) / sum(w), 6) as mean, round(sqrt((sum(w * p * p) - sum(w * p) * sum(w * p) / sum(w))
      / (sum(w) - sum(w * w) / sum(w))), 6) as std from v_scores group by 1""",
)
def a15(t):
    p, w = F.col("p"), F.col("w")
    return t.scores.groupBy("grp").agg(R.weighted_mean(p, w).alias("mean"), R.weighted_std(p, w).alias("std"))


@query(
    "A16_exact_percentile",
    """select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) as q0, round(quantile_cont(l_extendedprice, 0.5), 6) as q1,
    round(quantile_cont(l_extendedprice, 0.99), 6) as q2 from lineitem group by 1""",
)
def a16(t):
    return O.quantiles(t.lineitem, "l_extendedprice", [0.05, 0.5, 0.99], ["l_returnflag"])


WP = """with {v}, d as (select p, sum(w) as w from v_scores group by 1),
    s as (select p, sum(w) over (order by p) / sum(w) over () as s from d),
    e as (select max((s, p)) filter (where s <= {q}) as lo, min((s, p)) filter (where s > {q}) as hi from s)"""


@query(
    "A17_weighted_percentile",
    f"""with {V_SCORES}, d as (select p, sum(w) as w from v_scores group by 1),
    s as (select p, sum(w) over (order by p) / sum(w) over () as s from d),
    e as (select max(s) filter (where s <= 0.9) as slo, max(p) filter (where s <= 0.9) as plo,
      min(s) filter (where s > 0.9) as shi, min(p) filter (where s > 0.9) as phi from s)
    select round(plo + (0.9 - slo) * (phi - plo) / (shi - slo), 6) as value from e""",
)
def a17(t):
    return O.weighted_percentile(t.scores, "p", "w", 0.9)


def qcut_sql(table, col, q, where=""):
    edges = " ".join(f"when {col} <= (select quantile_cont({col}, {i / q}) from {table}) then {i}" for i in range(1, q))
    return f"case when {col} is null then null {edges} else {q} end"


@query(
    "A18_qcut",
    f"select bin, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi from (select l_extendedprice, {qcut_sql('lineitem', 'l_extendedprice', 5)} as bin from lineitem) group by 1",
)
def a18(t):
    b = O.qcut(t.lineitem.select("l_extendedprice"), "l_extendedprice", 5)
    return b.groupBy("bin").agg(N().alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query(
    "A19_cut",
    """with r as (select min(value) as lo, max(value) as hi from events)
    select 'width' as kind, least(4, greatest(1, ceil((value - lo) / ((hi - lo) / 4))))::int as bin, count(*) as n from events, r group by 2
    union all select 'breaks', case when value > 0 and value <= 10 then 1 when value > 10 and value <= 100 then 2 when value > 100 and value <= 400 then 3 end, count(*)
    from events group by 2""",
)
def a19(t):
    e = t.events.select("value")
    a = O.cut(e, "value", 4).groupBy(F.lit("width").alias("kind"), "bin").agg(N().alias("n"))
    b = O.cut(e, "value", [0, 10, 100, 400]).groupBy(F.lit("breaks").alias("kind"), "bin").agg(N().alias("n"))
    return a.unionByName(b)


@query(
    "A20_weighted_qcut",
    f"""with {V_SCORES}, d as (select p, sum(w) as w from v_scores group by 1),
    b as (select p, greatest(1, least(10, ceil(round(sum(w) over (order by p) / sum(w) over () * 10, 9))))::int as bin from d)
    select bin, count(*) as n, round(sum(w), 4) as weight from v_scores join b using (p) group by 1""",
    digits=4,
)
def a20(t):
    b = O.weighted_qcut(t.scores.select("p", "w"), "p", "w", 10)
    return b.groupBy("bin").agg(N().alias("n"), F.sum("w").alias("weight"))


@query(
    "A21_terciles",
    f"""with h as (select l_orderkey, case when l_linenumber = 2 then null else l_extendedprice end as x from lineitem)
    select tier, count(*) as n from (select coalesce(case {qcut_sql('h', 'x', 3)} when 1 then 'low' when 2 then 'med' when 3 then 'high' end, 'UNK') as tier from h) group by 1""",
)
def a21(t):
    x = F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice"))
    b = O.qcut(t.lineitem.select(x.alias("x")), "x", 3, duplicates="drop")
    tier = F.when(F.col("bin") == 1, "low").when(F.col("bin") == 2, "med").when(F.col("bin") == 3, "high").otherwise("UNK")
    return b.groupBy(tier.alias("tier")).agg(N().alias("n"))


@query(
    "A22_cluster_summary",
    """with b as (select p_type as c, count(*) as size, avg(p_size) as a, avg(p_retailprice) as r from part group by 1),
    m as (select avg(a) as ma, stddev_samp(a) as sa, avg(r) as mr, stddev_samp(r) as sr from b),
    k as (select p_type as c, p_brand, count(*) as n from part group by 1, 2),
    md as (select c, p_brand as mode_p_brand from k qualify row_number() over (partition by c order by n desc, p_brand) = 1)
    select c as p_type, size, round(a, 6) as mean_p_size, round(r, 6) as mean_p_retailprice, mode_p_brand,
      concat_ws(', ', case when r - mr > sr then 'high p_retailprice' end, case when a - ma > sa then 'high p_size' end,
        case when r - mr < -sr then 'low p_retailprice' end, case when a - ma < -sa then 'low p_size' end) as label
    from b join md using (c), m""",
)
def a22(t):
    return R.cluster_summary(t.part, "p_type", ["p_size", "p_retailprice"], ["p_brand"])


@query(
    "A23_uniqueness_check",
    """select count(*) as rows, count(distinct (l_orderkey, l_linenumber)) as keys, count(*) = count(distinct (l_orderkey, l_linenumber)) as is_unique from lineitem""",
)
def a23(t):
    k = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(N().alias("k"))
    return k.agg(F.sum("k").alias("rows"), N().alias("keys"), (F.max("k") == 1).alias("is_unique"))


@query(
    "A24_first_per_group",
    """with h as (select o_custkey, l_partkey, l_quantity, o_orderdate from orders join lineitem on l_orderkey = o_orderkey)
    select o_custkey, l_partkey, l_quantity, o_orderdate from h qualify row_number() over (partition by o_custkey, l_partkey order by l_quantity desc, o_orderdate desc) = 1""",
)
def a24(t):
    h = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return R.best_row(h, ["o_custkey", "l_partkey"], [F.col("l_quantity"), F.col("o_orderdate")], ["l_quantity", "o_orderdate"])


@query(
    "A25_confusion_counts",
    f"""with {V_SCORES}, c as (select y, (p >= 0.5)::int as pred_y, count(*) as n from v_scores group by 1, 2)
    select y, pred_y, n, sum(n) over (partition by y)::bigint as row_n, sum(n) over (partition by pred_y)::bigint as col_n,
      round(n / sum(n) over (partition by y), 6) as row_share, round(n / sum(n) over (partition by pred_y), 6) as col_share from c""",
)
def a25(t):
    s = t.scores.select("y", (F.col("p") >= 0.5).cast("int").alias("pred_y"))
    return R.confusion_counts(s, "y", "pred_y")


@query(
    "A26_normalise_tables",
    """select p_partkey, 'p_brand' as slot, p_brand as code, null as state from part union all select p_partkey, 'p_type', p_type, null from part
    union all select p_partkey, 'flag', 'big', 'Yes' from part where p_size > 25""",
)
def a26(t):
    wide = t.part.withColumn("big", F.when(F.col("p_size") > 25, "Yes").otherwise("No"))
    parts = R.split_to_tables(wide, "p_partkey", ["p_brand", "p_type"], ["big"])
    codes = parts["codes"].join(parts["lookup"], "code", "left_semi")
    flags = parts["flags"].select("p_partkey", F.lit("flag").alias("slot"), F.col("name").alias("code"), "state")
    return codes.select("p_partkey", "slot", "code", F.lit(None).cast("string").alias("state")).unionByName(flags)


@query(
    "A27_group_share",
    f"""with {V_SERIES}, s as (select series_id, date, target / sum(target) over (partition by date) as share from v_series)
    select series_id, date, round(share, 6) as share, round(ln(share / (1 - share)), 6) as logit from s where share < 1""",
)
def a27(t):
    s = R.share_in_group(t.series, ["date"], "target").filter("share < 1")
    return s.select("series_id", "date", "share", F.ln(F.col("share") / (1 - F.col("share"))).alias("logit"))


@query(
    "A28_describe_by",
    " union all ".join(
        f"""select l_returnflag, '{c}' as "column", count({c}) as n, round(sum({c}), 3) as sum, min({c}) as min, round(avg({c}), 3) as mean, max({c}) as max,
        round(stddev_samp({c}), 3) as sd, round(quantile_cont({c}, 0.25), 3) as q25, round(median({c}), 3) as median, round(quantile_cont({c}, 0.75), 3) as q75,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 3) as iqr from lineitem where {c} > 0 group by 1"""
        for c in ("l_quantity", "l_discount")
    ),
    digits=3,
)
def a28(t):
    return R.describe_by(t.lineitem, ["l_returnflag"], ["l_quantity", "l_discount"], positive_only=True)


@query(
    "A29_drop_uninformative",
    " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as n_distinct, count(*) as n, count(distinct {c}) > 1 and count(distinct {c}) < 0.99 * count(*) as kept
        from orders""" if c != "one" else """select 'one', 1, count(*), false from orders"""
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "one")
    ),
)
def a29(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("one"))
    kept = R.drop_uninformative(df).columns
    return R.distinct_counts(df).withColumn("kept", F.col("column").isin(kept))


@query(
    "A30_group_regression",
    """with g as (select p_brand, regr_slope(p_retailprice, p_size) as slope, regr_intercept(p_retailprice, p_size) as intercept from part group by 1)
    select p_partkey, round(intercept + slope * p_size, 6) as fitted from part join g using (p_brand)""",
)
def a30(t):
    g = R.group_regression(t.part, ["p_brand"], "p_retailprice", "p_size")
    return t.part.join(g, "p_brand").select("p_partkey", (F.col("intercept") + F.col("slope") * F.col("p_size")).alias("fitted"))
