"""Model-insight tables."""

from pyspark.sql import functions as F

from tabloom.operators import decisions as D, effects as E, factor, models as M
from tabloom.plans.aggregates import qcut_sql
from tabloom.plans.fixtures import V_POINTS, V_PROBS, V_RUNS, V_SCORES, V_SURVIVAL, V_TOUCH, V_TRIPLES
from tabloom.plans.registry import query
from tabloom.session import materialize, shuffled


def N():
    return F.count(F.lit(1))


def linear(df):
    """Scorer used by the effect queries: a plain expression over three line columns."""
    return df.withColumn("score", 0.5 + 0.01 * F.col("l_quantity") - F.col("l_discount") * F.col("l_quantity") / 50 + F.col("l_tax"))


SCORE = "0.5 + 0.01 * {q} - {d} * {q} / 50 + l_tax"


@query(
    "I01_pdp_grid",
    "select " + ", ".join(f"round(quantile_cont(l_extendedprice, {0.05 + 0.9 * i / 24}), 6) as g{i}" for i in range(25)) + " from lineitem",
    digits=6,
)
def i01(t):
    g = E.pdp_grid(t.lineitem, "l_extendedprice")
    return t.spark.createDataFrame([tuple(float(v) for v in g)], [f"g{i}" for i in range(25)])


@query(
    "I02_pdp",
    f"""with g as (select unnest([0.0, 0.02, 0.05, 0.08, 0.1])::double as d) select d as l_discount, round(avg({SCORE.format(q='l_quantity', d='d')}), 6) as mean,
    round(stddev_samp({SCORE.format(q='l_quantity', d='d')}), 6) as std, count(*) as n from lineitem, g group by 1""",
)
def i02(t):
    return E.pdp(t.lineitem, linear, "l_discount", [0.0, 0.02, 0.05, 0.08, 0.1])


@query(
    "I02_pdp_two_way",
    f"""with g as (select unnest([0.0, 0.05, 0.1])::double as d), h as (select unnest([5.0, 25.0, 45.0])::double as q)
    select d as l_discount, q as l_quantity, round(avg({SCORE.format(q='q', d='d')}), 6) as mean, round(stddev_samp({SCORE.format(q='q', d='d')}), 6) as std, count(*) as n from lineitem, g, h group by 1, 2""",
)
def i02b(t):
    return E.pdp(t.lineitem, linear, "l_discount", [0.0, 0.05, 0.1], "l_quantity", [5.0, 25.0, 45.0])


@query(
    "I02_top_and_other",
    """with top as (select p_name from part group by 1 order by count(*) desc, 1 limit 3) select case when p_name in (select p_name from top) then p_name else 'OTHER' end as p_name,
    round(avg(p_retailprice), 4) as mean, count(*) as n from part group by 1""",
    digits=4,
)
def i02c(t):
    x = E.top_and_other(t.part, "p_name", 3)
    return x.groupBy("p_name").agg(F.avg("p_retailprice").alias("mean"), N().alias("n"))


@query(
    "I03_ice",
    f"""with g as (select unnest([0.0, 0.05, 0.1])::double as d), l as (select o_orderkey, o_totalprice / 10000 as l_quantity, o_custkey / 100000 as l_tax from orders)
    select o_orderkey, d as l_discount, round({SCORE.format(q='l_quantity', d='d')}, 9) as score, round(({SCORE.format(q='l_quantity', d='d')}) - ({SCORE.format(q='l_quantity', d='0')}), 9) + 0 as relative from l, g""",
    digits=9,
)
def i03(t):
    o = t.orders.select("o_orderkey", (F.col("o_totalprice") / 10000).alias("l_quantity"), (F.col("o_custkey") / 100000).alias("l_tax"), F.lit(0.0).alias("l_discount"))
    return E.ice(o, linear, "l_discount", [0.0, 0.05, 0.1], "o_orderkey")


@query(
    "I04_geographic_grid",
    """with a as (select c_nationkey as n, avg(c_acctbal) as bal from customer group by 1), g as (select unnest([1.0, 2.0])::double as exposure)
    select n_nationkey % 5 as lon, n_nationkey // 5 as lat, exposure, round(bal * exposure, 4) as score from nation join a on n = n_nationkey, g""",
    digits=4,
)
def i04(t):
    areas = t.nation.select("n_nationkey", (F.col("n_nationkey") % 5).alias("lon"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("lat"))
    attrs = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("bal"))
    g = E.area_grid(areas, "lon", "lat", attrs, "n_nationkey", {"exposure": [1.0, 2.0]})
    return g.select("lon", "lat", "exposure", (F.col("bal") * F.col("exposure")).alias("score"))


@query(
    "I05_lift_table",
    f"""with {V_SCORES}, b as (select *, {qcut_sql('v_scores', 'p', 10)} as b from v_scores) select dense_rank() over (order by b) as bin, round(avg(p), 6) as mean_pred, round(avg(y), 6) as mean_actual, count(*) as n from b group by b""",
)
def i05(t):
    return D.lift_table(t.scores, "y", "p", 10)


@query(
    "I05_lift_table_weighted",
    f"""with {V_SCORES}, d as (select p, sum(w) as w from v_scores group by 1), e as (select p, greatest(1, least(10, ceil(round(sum(w) over (order by p) / sum(w) over () * 10, 9)))) as b from d)
    select dense_rank() over (order by b) as bin, round(sum(p * w) / sum(w), 6) as mean_pred, round(sum(y * w) / sum(w), 6) as mean_actual, count(*) as n from v_scores join e using (p) group by b""",
)
def i05b(t):
    return D.lift_table(t.scores, "y", "p", 10, "w")


ROC = """d as (select p, sum(y)::double as pos, sum(1 - y)::double as neg from v_scores group by 1), r as (select p as threshold, sum(pos) over w as tp, sum(neg) over w as fp,
    sum(neg) over () - sum(neg) over w as tn, sum(pos) over () - sum(pos) over w as fn from d window w as (order by p desc))"""


@query("I06_roc_points", f"with {V_SCORES}, {ROC} select round(threshold, 6) as threshold, tp, fp, tn, fn, round(tp / (tp + fn), 6) as tpr, round(fp / (fp + tn), 6) as fpr from r")
def i06(t):
    return D.roc_points(t.scores, "y", "p")


@query(
    "I07_best_threshold",
    f"""with {V_SCORES}, {ROC}, f as (select 'f2' as kind, *, 5 * tp / (5 * tp + 4 * fn + fp) as objective from r union all select 'payoff', *, 3 * tp - fp + 0.5 * tn - 2 * fn from r)
    select kind, round(threshold, 6) as threshold, tp, fp, tn, fn, round(tp / (tp + fn), 6) as tpr, round(fp / (fp + tn), 6) as fpr, round(objective, 6) as objective from f
    qualify row_number() over (partition by kind order by objective desc, threshold desc) = 1""",
)
def i07(t):
    pts = D.roc_points(t.scores, "y", "p")
    a = D.best_threshold(pts, D.f_beta(2.0)).withColumn("kind", F.lit("f2"))
    return a.unionByName(D.best_threshold(pts, D.payoff(3, -1, 0.5, -2)).withColumn("kind", F.lit("payoff")))


@query(
    "I08_value_curve",
    f"""with {V_SCORES}, {ROC} select round(threshold, 6) as threshold, 2 * tp - fp + tn - 3 * fn as value from r
    union all select round(max(p) * 1.1, 6), sum(1 - y)::double - 3 * sum(y) from v_scores union all select round(min(p) * 0.9, 6), 2 * sum(y)::double - sum(1 - y) from v_scores""",
)
def i08(t):
    return D.value_curve(t.scores, "y", "p", 2, -1, 1, -3)


@query(
    "I09_confusion_at",
    f"""with {V_SCORES} select 'default' as kind, count(*) filter (where y = 1 and p >= 0.5) as tp, count(*) filter (where y = 0 and p >= 0.5) as fp, count(*) filter (where y = 0 and p < 0.5) as tn,
    count(*) filter (where y = 1 and p < 0.5) as fn from v_scores union all select 'strict', count(*) filter (where y = 1 and p > 0.5), count(*) filter (where y = 0 and p >= 0.5),
    count(*) filter (where y = 0 and p < 0.5), count(*) filter (where y = 1 and p <= 0.5) from v_scores""",
)
def i09(t):
    a = D.confusion_at(t.scores, "y", "p", 0.5).withColumn("kind", F.lit("default"))
    return a.unionByName(D.confusion_at(t.scores, "y", "p", 0.5, True).withColumn("kind", F.lit("strict")))


@query(
    "I10_best_f1_matrix",
    f"with {V_SCORES}, {ROC} select round(threshold, 6) as threshold, tp, fp, tn, fn, round(2 * tp / (2 * tp + fn + fp), 6) as f1 from r order by 2 * tp / (2 * tp + fn + fp) desc, threshold desc limit 1",
)
def i10(t):
    return D.best_f1_matrix(t.scores, "y", "p")


@query(
    "I11_campaign_curve",
    f"""with {V_SCORES}, d as (select p * 30 - 12 as profit, count(*) as n from v_scores group by 1)
    select round(profit, 4) + 0 as profit, (sum(n) over w)::bigint as size, round(sum(profit * n) over w, 4) + 0 as cum_profit from d window w as (order by profit desc)""",
    digits=4,
)
def i11(t):
    return D.campaign_curve(t.scores, "p", 30.0, 12.0)


@query(
    "I11_campaign_optimum",
    f"""with {V_SCORES}, d as (select p * 30 - 12 as profit, count(*) as n from v_scores group by 1), c as (select sum(n) over w as size, sum(profit * n) over w as cum_profit from d window w as (order by profit desc))
    select size::bigint as size, round(cum_profit, 4) as cum_profit from c order by cum_profit desc, size limit 1""",
    digits=4,
)
def i11b(t):
    return D.campaign_optimum(D.campaign_curve(t.scores, "p", 30.0, 12.0))


def touch_score(df):
    f, s, m = F.col("facebook"), F.col("search"), F.col("sms")
    return df.withColumn("score", 0.1 + 0.2 * f + 0.15 * s + 0.05 * m + 0.1 * f * s)


TS = "0.1::double + 0.2 * (s & 1) + 0.15 * ((s >> 1) & 1) + 0.05 * ((s >> 2) & 1) + 0.1 * (s & 1) * ((s >> 1) & 1)"


@query(
    "I12_attribution",
    f"""with {V_TOUCH}, b as (select id, facebook + 2 * search + 4 * sms as bits from v_touch where purchase = 1), l as (select id, bits, s::int as s from b, (select unnest(range(8)) as s) where (bits & s) = s),
    g as (select id, max(case when s = 0 then {TS} end) as base, """
    + ", ".join(f"case when max((bits >> {i}) & 1) = 1 then sum(case when ((s >> {i}) & 1) = 1 then {TS} else -({TS}) end) else 0 end as c{i}" for i in range(3))
    + """ from l group by 1) select id, round(base / (base + c0 + c1 + c2), 6) as contrib_baseline, round(c0 / (base + c0 + c1 + c2), 6) as contrib_facebook,
    round(c1 / (base + c0 + c1 + c2), 6) as contrib_search, round(c2 / (base + c0 + c1 + c2), 6) as contrib_sms from g""",
)
def i12(t):
    return E.attribution(t.touch.filter("purchase = 1"), touch_score, ["facebook", "search", "sms"], "id")


OPTIONS = {"price": [float(i) for i in range(1, 10)], "hour": list(range(24)), "day": list(range(7))}


def option_score(o):
    return F.pmod(F.col("c_custkey") * 7 + o["hour"] * 13 + o["day"] * 29, F.lit(101)) * o["price"] - o["price"] * o["price"] * 11.0


@query(
    "I13_best_option",
    """with o as (select p.price::double as price, h.hour::int as hour, d.day::int as day, (p.price - 1) + 9 * h.hour + 216 * d.day as o from (select unnest(range(1, 10)) as price) p, (select unnest(range(24)) as hour) h, (select unnest(range(7)) as day) d),
    s as (select c_custkey, price, hour, day, o, ((c_custkey * 7 + hour * 13 + day * 29) % 101) * price - price * price * 11.0 as score from customer, o)
    select c_custkey, arg_max(price, (score, -o)) as price, arg_max(hour, (score, -o)) as hour, arg_max(day, (score, -o)) as day, max(score) as score from s group by 1""",
)
def i13(t):
    """1 512 option combinations scored per customer."""
    return E.best_option_by(t.customer.select("c_custkey"), OPTIONS, option_score, "c_custkey")


ITEMS = ["ECONOMY", "PROMO", "STANDARD", "LARGE", "MEDIUM", "SMALL"]


@query(
    "I14_assortment_value",
    """with u as (select p_type, sum(l_quantity) as units from lineitem join part on p_partkey = l_partkey group by 1), i as (select * from (values (0, 'ECONOMY'), (1, 'PROMO'), (2, 'STANDARD'), (3, 'LARGE'), (4, 'MEDIUM'), (5, 'SMALL')) t(k, p_type)),
    s as (select unnest(range(1, 64)) as set_id), v as (select set_id, sum(case when ((set_id >> k) & 1) = 1 then coalesce(units, 0) else 0 end)::double as value from s, i left join u using (p_type) where bit_count(set_id) in (2, 3) group by 1)
    select set_id, value, row_number() over (order by value desc, set_id desc) as rank from v""",
)
def i14(t):
    units = t.lineitem.join(shuffled(t.part), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type").agg(F.sum("l_quantity").alias("units"))
    return E.assortment_value(E.item_sets(t.part, ITEMS, [2, 3]), units, ITEMS, "p_type", "units")


@query("I15_quota_assign")
def i15(t):
    n = t.probs.count()
    lo = {"app": n // 20, "text": n // 20, "email": n // 10}
    return D.quota_assign(t.probs, "id", ["app", "text", "email"], lo, {"app": n // 4, "text": n // 3, "email": n // 3}, n * 3 // 4)


@query("I16_permute_column", "select count(*) as n, sum(o_orderkey)::bigint as keys, round(sum(o_totalprice), 2) as total, true as moved from orders", digits=2)
def i16(t):
    p = E.permute_column(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", seed=3)
    same = p.join(t.orders.select("o_orderkey", F.col("o_totalprice").alias("was")), "o_orderkey")
    return same.agg(N().alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("o_totalprice").alias("total"), (F.avg((F.col("was") == F.col("o_totalprice")).cast("int")) < 0.5).alias("moved"))


def impacts(t):
    """Feature impacts per run: mean line values per (supplier as run, brand as feature)."""
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(F.col("l_suppkey").alias("run"), F.col("p_brand").alias("feature")).agg((F.avg("l_extendedprice") - 20000).alias("value"))


IMPACTS = "imp as (select l_suppkey as run, p_brand as feature, avg(l_extendedprice) - 20000 as value from lineitem join part on p_partkey = l_partkey group by 1, 2)"


@query(
    "I17_null_importance",
    f"with {IMPACTS}, a as (select feature, value from imp where run = 0), n as (select feature, value from imp where run <> 0) select a.feature, round(coalesce(avg((n.value >= a.value)::int), 0), 6) as null_share from a left join n using (feature) group by 1",
)
def i17(t):
    x = impacts(t)
    return M.null_importance(x.filter("run = 0"), x.filter("run <> 0"), "feature", "value")


@query(
    "I18_importance_rollup",
    f"""with {IMPACTS}, g as (select feature, median(value / (select max(value) from imp)) as m, avg(greatest(value, 0)) as v from imp group by 1),
    c as (select *, sum(v) over (order by v desc) / sum(v) over () as s from g) select feature, round(m, 6) as norm_median, round(v, 6) as mean_value, m > 0.3 as above_cutoff, round(s, 9) <= 0.5 as within_share from c""",
)
def i18(t):
    return M.importance_rollup(impacts(t), "feature", "value", 0.3, 0.5)


REASONS = """rs as (select o_orderkey, 'total' as feature, o_totalprice / 100000 - 2 as strength, cast(o_custkey as varchar) as value from orders union all
    select o_orderkey, 'status', case o_orderstatus when 'F' then 1.5 else -0.5 end, o_orderstatus from orders union all select o_orderkey, 'priority', -ascii(o_orderpriority) / 50.0, o_orderpriority from orders)"""


def reasons(t):
    o = t.orders
    cells = F.array(
        F.struct(F.lit("total").alias("feature"), (F.col("o_totalprice") / 100000 - 2).alias("strength"), F.col("o_custkey").cast("string").alias("value")),
        F.struct(F.lit("status").alias("feature"), F.when(F.col("o_orderstatus") == "F", 1.5).otherwise(-0.5).alias("strength"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("feature"), (-F.ascii("o_orderpriority") / 50.0).alias("strength"), F.col("o_orderpriority").alias("value")),
    )
    return o.select("o_orderkey", F.inline(cells))


RW = ", ".join(f"max({c}) filter (where r = {i}) as reason_{i}_{c}" if c != "strength" else f"round(max(strength) filter (where r = {i}), 8) + 0 as reason_{i}_strength" for i in (1, 2) for c in ("feature", "strength", "value"))


@query("I19_reasons_wide", f"with {REASONS}, r as (select *, row_number() over (partition by o_orderkey order by abs(strength) desc, feature) as r from rs) select o_orderkey, {RW} from r group by 1", digits=8)
def i19(t):
    return M.reasons_wide(reasons(t), "o_orderkey", 2)


@query(
    "I19_reasons_long",
    f"with {REASONS}, r as (select *, row_number() over (partition by o_orderkey order by abs(strength) desc, feature)::int as rank from rs) select o_orderkey, rank, feature, round(strength, 8) + 0 as strength, value from r where rank <= 2",
    digits=8,
)
def i19b(t):
    return M.reasons_long(M.reasons_wide(reasons(t), "o_orderkey", 2), "o_orderkey", 2)


@query(
    "I20_strength_matrix",
    f"with {REASONS} select o_orderkey, " + ", ".join(f"round(sum(strength) filter (where feature = '{f}'), 8) + 0 as {f}" for f in ("priority", "status", "total")) + " from rs group by 1",
    digits=8,
)
def i20(t):
    return M.strength_matrix(reasons(t), "o_orderkey", ["priority", "status", "total"])


@query("I20_strength_clusters")
def i20b(t):
    """Rows grouped by what speaks for and against them."""
    return M.strength_clusters(reasons(t), "o_orderkey", ["priority", "status", "total"], 4)


@query(
    "I21_scorecard",
    """with c as (select 'brand' as feature, p_brand as level, avg(p_retailprice) / 1000 as coef from part group by 2 union all select 'type', p_type, avg(p_size) / 10 from part group by 2),
    m as (select feature, level, -coef as c, min(-coef) over (partition by feature) as lo from c), s as (select sum(hi - lo) as span from (select feature, max(coef) as hi, min(coef) as lo from c group by 1))
    select feature, level, round((c - lo) * 550 / span, 6) as points, 300.0::double as baseline from m, s""",
)
def i21(t):
    a = t.part.groupBy(F.lit("brand").alias("feature"), F.col("p_brand").alias("level")).agg((F.avg("p_retailprice") / 1000).alias("coef"))
    b = t.part.groupBy(F.lit("type").alias("feature"), F.col("p_type").alias("level")).agg((F.avg("p_size") / 10).alias("coef"))
    return M.scorecard(a.unionByName(b), -1.0)


@query(
    "I22_conformal_interval",
    f"""with {V_SCORES}, tr as (select abs(actual - pred) / w as r from v_scores where grp = 'F'), d as (select quantile_cont(r, 0.9) as d, (select avg((r <= (select quantile_cont(r, 0.9) from tr))::int) from tr) as coverage from tr)
    select l_orderkey, l_partkey, l_suppkey, round(pred - d * w, 4) as lower, round(pred + d * w, 4) as upper, round(coverage, 4) as coverage from v_scores, d where grp = 'O'""",
    digits=4,
)
def i22(t):
    s = t.scores
    out = M.conformal_interval(s.filter("grp = 'F'"), s.filter("grp = 'O'"), "actual", "pred", 0.1, "w")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "lower", "upper", "coverage")


@query(
    "I23_stack_predictions",
    "select o_orderkey, 'H' as part, round(o_totalprice / 2, 4) as half, round(ln(o_totalprice), 4) as log, round(o_totalprice * 2, 4) as twice from orders",
    digits=4,
)
def i23(t):
    x = F.col("o_totalprice")
    cells = [F.struct(F.lit(n).alias("model"), v.alias("p")) for n, v in (("half", x / 2), ("log", F.ln(x)), ("twice", x * 2))]
    long = t.orders.select("o_orderkey", F.lit("H").alias("part"), F.inline(F.array(*cells)))
    return M.stack_predictions(long, ["o_orderkey", "part"], "model", ["half", "log", "twice"], "p")


@query(
    "I24_fairness",
    f"""with {V_SCORES}, g as (select l_suppkey % 10 as a, avg((p >= 0.5)::int) filter (where y = 1) as f, avg((p < 0.5)::int) filter (where y = 0) as u, avg(y) filter (where p >= 0.5) as v, count(*) as n from v_scores group by 1)
    select a, round(f, 6) as favourable_balance, round(1 - (1 - u), 6) as unfavourable_balance, round(v, 6) as predictive_value, n, round(f / max(f) over (), 6) as favourable_balance_ratio,
    round(u / max(u) over (), 6) as unfavourable_balance_ratio, round(v / max(v) over (), 6) as predictive_value_ratio, f / max(f) over () < 0.8 as favourable_balance_flag,
    u / max(u) over () < 0.8 as unfavourable_balance_flag, v / max(v) over () < 0.8 as predictive_value_flag from g""",
)
def i24(t):
    s = t.scores.select((F.col("l_suppkey") % 10).alias("a"), "y", (F.col("p") >= 0.5).cast("int").alias("said"))
    return M.fairness(s, "a", "y", "said")


LEAK = "lk as (select p_partkey, (p_retailprice - 900) / 200 as score, (p_partkey % 4 = 0)::int as truth from part)"


@query("I25_leakage_flags", f"with {LEAK} select risk, count(*) as n from (select case when score >= 0.975 then 'high' when score >= 0.85 then 'moderate' else 'none' end as risk from lk) group by 1")
def i25(t):
    return M.leakage_flags(leaks(t), "score").groupBy("risk").agg(N().alias("n"))


def leaks(t):
    return t.part.select("p_partkey", ((F.col("p_retailprice") - 900) / 200).alias("score"), (F.col("p_partkey") % 4 == 0).cast("int").alias("truth"))


@query(
    "I25_leakage_sweep",
    f"""with {LEAK}, th as (select round(1 - 0.025::double * i, 3) as threshold from (select unnest(range(40)) as i)), f as (select threshold, truth, score >= 0.975 or score >= threshold as hit from lk, th)
    select threshold, count(*) filter (where hit and truth = 1) as true_positive, count(*) filter (where hit and truth = 0) as false_positive, count(*) filter (where not hit and truth = 1) as false_negative,
    count(*) filter (where not hit and truth = 0) as true_negative from f group by 1""",
)
def i25b(t):
    return M.leakage_sweep(leaks(t), "score", "truth")


@query("I26_univariate_strength")
def i26(t):
    d = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return M.univariate_strength(d, "y", ["l_quantity", "l_extendedprice"], ["l_linestatus", "l_returnflag"], key)


STRENGTH = """g as (select feature, level, fold, class, count(*) as s from long group by all), h as (select feature, level, fold, sum(s) as n from g group by all), size as (select class, count(*) as size from x group by 1),
    f as (select h.*, c.class, coalesce(g.s, 0) as s from h cross join size c left join g on g.feature = h.feature and g.level is not distinct from h.level and g.fold = h.fold and g.class = c.class),
    t as (select *, sum(n) over w as all_n, sum(s) over w as all_s from f window w as (partition by feature, level, class)),
    p as (select feature, class, case when all_n = n then 0.5 else (all_s - s) / (all_n - n) end as p, s as pos, n - s as neg from t),
    q as (select feature, class, p, sum(pos) as pos, sum(neg) as neg from p group by 1, 2, 3), r as (select *, sum(neg) over (partition by feature, class order by p) - neg as below, sum(pos) over (partition by feature, class) as tp, sum(neg) over (partition by feature, class) as tn from q),
    a as (select feature, class, sum(pos * (below + 0.5 * neg)) / max(tp * tn) as auc from r group by 1, 2)"""


@query(
    "I26_univariate_strength_folds",
    f"""with x as (select *, (l_returnflag = 'R')::int as class, l_orderkey % 5 as fold from lineitem), long as (select 'l_linestatus' as feature, l_linestatus as level, fold, class from x union all select 'l_linenumber', l_linenumber::varchar, fold, class from x), {STRENGTH}
    select feature, round(auc, 6) as auc, round(2 * (auc - 0.5), 6) + 0 as strength from a where class = 1""",
)
def i26c(t):
    """Folds that SQL repeats."""
    d = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return M.univariate_strength(d, "y", [], ["l_linestatus", "l_linenumber"], [], fold=(F.col("l_orderkey") % 5).cast("int"))


@query(
    "I26_multiclass_strength",
    f"""with x as (select *, l_returnflag as class, l_orderkey % 5 as fold from lineitem), long as (select 'l_linestatus' as feature, l_linestatus as level, fold, class from x union all select 'l_linenumber', l_linenumber::varchar, fold, class from x
      union all select 'l_quantity', l_quantity::int::varchar, fold, class from x), {STRENGTH}, m as (select feature, sum(auc * size) / sum(size) as auc from a join size using (class) group by 1) select feature, round(auc, 6) as auc, round(2 * (auc - 0.5), 6) + 0 as strength from m""",
)
def i26b(t):
    """Three classes, each against the others, weighted by their shares."""
    d = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("int"))
    return M.multiclass_strength(d, "l_returnflag", [], ["l_linestatus", "l_linenumber", "l_quantity"], [], fold=(F.col("l_orderkey") % 5).cast("int"))


KM = """t as (select segment, tenure, count(*) as n, sum(event) as d from v_survival group by 1, 2), r as (select *, sum(n) over (partition by segment order by tenure desc) as risk from t),
    k as (select segment, tenure, risk::bigint as at_risk, d::bigint as events, case when min(risk - d) over w = 0 then 0 else exp(sum(case when risk = d then 0 else ln(1 - d / risk) end) over w) end as survival
      from r window w as (partition by segment order by tenure))"""


@query("I27_kaplan_meier", f"with {V_SURVIVAL}, {KM} select segment, tenure, at_risk, events, round(survival, 6) as survival from k")
def i27(t):
    return M.kaplan_meier(t.survival, "tenure", "event", ["segment"])


@query("I27_time_at_survival", f"with {V_SURVIVAL}, {KM} select segment, min(tenure) as time from k where round(survival, 2) = 0.75 group by 1")
def i27b(t):
    return M.time_at_survival(M.kaplan_meier(t.survival, "tenure", "event", ["segment"]), "tenure", 0.75, ["segment"])


@query(
    "I28_survival_expansion",
    f"""with {V_SURVIVAL}, {KM}, p as (select id, event, case when event = 1 then 1 else 1 - survival end as pr from v_survival join k using (segment, tenure))
    select id, 1 as outcome, round(pr, 6) as weight from p union all select id, 0, round(1 - pr, 6) from p where event = 0""",
)
def i28(t):
    km = M.kaplan_meier(t.survival, "tenure", "event", ["segment"])
    p = M.event_probability(t.survival, km, "tenure", "event", ["segment"])
    return M.expand_censored(p, "event", "prob_event").select("id", "outcome", "weight")


@query(
    "I29_meta_recommend",
    f"""with {V_TRIPLES}, x as (select project, item, asinh(score) as s from v_triples where project <> 0), q as (select item, asinh(score) as s from v_triples where project = 0),
    sims as (select x.project, sum(x.s * q.s) / (n.norm * (select sqrt(sum(s * s)) from q)) as sim from x join q using (item) join (select project, sqrt(sum(s * s)) as norm from x group by 1) n on n.project = x.project group by x.project, n.norm),
    c as (select item, avg(sim * s) as rec_mean, median(s) as med from x join sims using (project) where sim > 0.05 and item not in (select item from q) group by 1),
    nm as (select p_brand, p_name, count(*) as n from part group by 1, 2 qualify row_number() over (partition by p_brand order by length(p_name) desc, count(*) desc, p_name desc) = 1),
    f as (select item, p_name, rec_mean, med, 0.2023 + 1.0364 * rec_mean + 0.2704 * greatest(med, 0) as fs from c join nm on p_brand = item)
    select item, round(rec_mean, 6) as rec_mean, round(med, 6) as score_median, round(fs, 6) as final_score, p_name from f order by fs desc, item limit 10""",
)
def i29(t):
    x = t.triples.filter("project <> 0")
    q = t.triples.filter("project = 0").select("item", F.asinh("score").alias("score"))
    names = M.longest_name(t.part, "p_brand", "p_name").withColumnRenamed("p_brand", "item")
    return M.meta_recommend(x, q, names, "project", "item", "score")


@query(
    "I30_compare_runs",
    f"""with {V_RUNS}, l as (select * from v_runs qualify project_date = max(project_date) over (partition by run, file)), g as (select file, max(gini_h) filter (where run = 'F') as a, max(gini_h) filter (where run = 'O') as b,
      min(total_time) filter (where run = 'F') as c, min(total_time) filter (where run = 'O') as d from l group by 1),
    u as (select file, 'gini_h' as measure, 1 as sign, a as old, b as new from g union all select file, 'total_time', -1, c, d from g)
    select file, measure, round(old, 6) as old, round(new, 6) as new, round(new - old, 6) + 0 as diff, round((new - old) / nullif(abs(old), 0), 6) + 0 as pct, (new - old) * sign < 0 as regression from u where old is not null and new is not null""",
)
def i30(t):
    return M.compare_runs(t.runs, "run", "F", "O", ["file"], ["gini_h"], ["total_time"], "project_date")


@query("I31_stress_values")
def i31(t):
    v = M.stress_values(t.events.select("value"), ["value"], 0.02)
    return v


@query("I31_stress_scores")
def i31b(t):
    v = M.stress_values(t.lineitem, ["l_extendedprice"], 0.02)
    top = [r["value"] for r in v.collect()]  # at most the number of histogram bins
    return M.stress_scores(t.lineitem, lambda d: d.withColumn("score", F.ln("l_extendedprice") - F.col("l_discount")), "l_extendedprice", top)


@query(
    "I32_double_mad",
    """with m as (select median(value) as med from events), x as (select event_id, value, med, abs(value - med) as dev from events, m), s as (select median(dev) filter (where value <= med) as l, median(dev) filter (where value >= med) as r from x)
    select event_id, round(case when dev = 0 then 0 when value <= med then dev / l else dev / r end, 6) as distance from x, s""",
)
def i32(t):
    return M.double_mad(t.events, "value").select("event_id", "distance")


@query("I33_cluster_confidence")
def i33(t):
    return M.cluster_confidence(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], 4)


@query(
    "I34_scale",
    """with s as (select avg(p_retailprice) as a, stddev_pop(p_retailprice) as d, min(p_size) as lo, max(p_size) as hi from part), b as (select median(p_retailprice) as m, quantile_cont(p_retailprice, 0.25) as q1, quantile_cont(p_retailprice, 0.75) as q3 from part)
    select p_partkey, round((p_retailprice - a) / d, 5) + 0 as standard, round((p_size - lo) / (hi - lo), 5) as minmax, round((p_retailprice - m) / (q3 - q1), 5) + 0 as robust from part, s, b""",
    digits=5,
)
def i34(t):
    p = t.part.select("p_partkey", F.col("p_retailprice").alias("standard"), F.col("p_size").alias("minmax"), F.col("p_retailprice").alias("robust"))
    return M.scale(M.scale(M.scale(p, ["standard"]), ["minmax"], "minmax"), ["robust"], "robust")


@query(
    "I34_ridit",
    """with c as (select p_size, count(*) as n from part group by 1), r as (select p_size, 2 * (sum(n) over (order by p_size) - n / 2) / sum(n) over () - 1 as ridit from c) select p_partkey, round(ridit, 6) + 0 as ridit from part join r using (p_size)""",
)
def i34b(t):
    return M.ridit(t.part, "p_size").select("p_partkey", "ridit")


@query(
    "I35_difference_encode",
    """with g as (select s_suppkey, s_nationkey as a, (s_nationkey * 3 + s_suppkey) % 25 as b from supplier) select s_suppkey, level, sum(v)::int as value from (select s_suppkey, a::bigint as level, 1 as v from g union all select s_suppkey, b::bigint, -1 from g)
    group by 1, 2 having sum(v) <> 0""",
)
def i35(t):
    g = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_nationkey") * 3 + F.col("s_suppkey")) % 25).alias("b"))
    return M.difference_encode(g, ["s_suppkey"], "a", "b")


@query("I36_svd_features")
def i36(t):
    return M.svd_features(t.triples, "project", "item", "score", 3)


@query("I36_svd_reconstruction", f"with {V_TRIPLES} select project, item, round(score, 5) as value from v_triples", digits=5)
def i36b(t):
    """As many components as there are items give back every cell."""
    cells = materialize(t.triples)
    k = cells.select("item").distinct().count()
    return factor.reconstruct(factor.svd(cells, "project", "item", "score", k), cells.select("project", "item"), "project", "item", k)


NEAR = " + ".join(f"abs(a.{c} - b.{c})" for c in "xyz")


@query(
    "I37_price_vicinity",
    f"""with {V_POINTS}, v as (select a.id, a.price as own, count(*) as n, min(b.price) as lo, max(b.price) as hi, median(b.price) as med from v_points a join v_points b on a.aisle = b.aisle and a.id <> b.id and {NEAR} <= 8 group by 1, 2)
    select p.id, case when n > 2 then round(hi - lo, 6) end as price_range, case when n > 2 then round(own / lo, 6) end as ratio_min, case when n > 2 then round(own / med, 6) end as ratio_median,
    case when n > 2 then round(own / hi, 6) end as ratio_max, coalesce((n > 2 and own >= hi)::int, 0) as is_highest, coalesce((n > 2 and own <= lo)::int, 0) as is_lowest from v_points p left join v using (id)""",
)
def i37(t):
    return M.price_vicinity(t.points, "id", ["aisle"], ["x", "y", "z"], 8.0)


@query(
    "I38_category_vicinity",
    f"""with {V_POINTS}, v as (select a.id, a.color as own, b.color as c, count(*) as n from v_points a join v_points b on a.aisle = b.aisle and a.id <> b.id and {NEAR} <= 8 group by 1, 2, 3)
    select id, arg_min(c, (-n, c)) as dominant, sum(n)::bigint as neighbours, round(coalesce(sum(n) filter (where c = own), 0) / sum(n), 6) as same_share, any_value(own) || '|' || arg_min(c, (-n, c)) as own_vs_dominant from v group by 1""",
)
def i38(t):
    return M.category_vicinity(t.points, "id", ["aisle"], ["x", "y", "z"], 8.0, "color")


@query("I39_centroids", f"with {V_POINTS} select id, round(avg(x) over w, 6) as avg_x, round(avg(y) over w, 6) as avg_y, round(avg(z) over w, 6) as avg_z from v_points window w as (partition by aisle, color)")
def i39(t):
    return M.centroids(t.points, ["aisle", "color"], ["x", "y", "z"]).select("id", "avg_x", "avg_y", "avg_z")


@query(
    "I40_tier_assign",
    """with c as (select l_quantity * 900 * 3 as need, l_extendedprice as actual, l_tax * 3600 + 10 as secs from lineitem), x as (select *, case when need >= 30720 then 61440 when need >= 20480 then 30720 when need >= 10240 then 20480 when need >= 5120 then 10240 else 5120 end as tier from c),
    y as (select *, 61440 * secs * 0.001 as old_cost, tier * secs * 0.001 + case when need < actual then 61440 * secs * 0.001 else 0 end as new_cost from x)
    select tier::double as tier, count(*) as n, round(sum(old_cost) - sum(new_cost), 3) as savings, round((sum(old_cost) - sum(new_cost)) / sum(old_cost), 3) as share, count(*) filter (where new_cost > old_cost) as dearer from y group by 1""",
    digits=3,
)
def i40(t):
    x = t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("actual"), (F.col("l_tax") * 3600 + 10).alias("secs"))
    c = D.tier_assign(x, F.col("l_quantity") * 900 * 3, [5120, 10240, 20480, 30720, 61440], 61440.0, "secs", "actual", 0.001)
    s = F.sum("old_cost") - F.sum("new_cost")
    return c.groupBy("tier").agg(N().alias("n"), s.alias("savings"), (s / F.sum("old_cost")).alias("share"), F.count_if(F.col("new_cost") > F.col("old_cost")).alias("dearer"))


@query(
    "I41_rank_features",
    f"""with {IMPACTS}, r as (select feature, row_number() over (partition by run order by value desc, feature) as rank from imp)
    select feature, sum(rank)::bigint as rank_sum, round(avg(rank), 6) as rank_mean, round(stddev_samp(rank), 6) as rank_sd, count(*) as models, median(rank) as rank_median from r group by 1 order by avg(rank), feature limit 10""",
)
def i41(t):
    return M.rank_features(impacts(t), ["run"], "feature", "value", 10)


@query("I42_complete_matrix")
def i42(t):
    return M.complete_matrix(t.triples, "project", "item", "score", 4)[0]


@query("I42_completion_error")
def i42b(t):
    return M.complete_matrix(t.triples, "project", "item", "score", 4)[1]


@query("I15_quota_limits", f"with {V_PROBS} select (count(*) * 3 // 4)::bigint as assigned, true as minimums, true as maximums, true as one_each from v_probs")
def i15b(t):
    """The assignment of I15 meets its total and every quota, with one choice per row."""
    n = t.probs.count()
    lo = {"app": n // 20, "text": n // 20, "email": n // 10}
    hi = {"app": n // 4, "text": n // 3, "email": n // 3}
    q = D.quota_assign(t.probs, "id", ["app", "text", "email"], lo, hi, n * 3 // 4)
    c = {k: F.count_if(F.col("choice") == k) for k in lo}
    ok_lo, ok_hi = F.lit(True), F.lit(True)
    for k in lo:
        ok_lo, ok_hi = ok_lo & (c[k] >= lo[k]), ok_hi & (c[k] <= hi[k])
    return q.agg(N().alias("assigned"), ok_lo.alias("minimums"), ok_hi.alias("maximums"), (F.count_distinct("id") == N()).alias("one_each"))


@query(
    "I31_stress_values_sql",
    """with s as (select min(value) as lo, (max(value) - min(value)) / 50 as w from events), h as (select least(floor((value - lo) / w), 49)::int as bin, count(*) as n from events, s group by 1),
    t as (select bin, n, least(sum(n) over (order by bin), sum(n) over (order by bin desc)) / sum(n) over () as tail, n / sum(n) over () as density from h)
    select 'value' as "column", bin, round(lo + (bin + 0.5) * w, 6) as value, round(density, 6) as density from t, s where tail < 0.02""",
)
def i31c(t):
    return M.stress_values(t.events.select("value"), ["value"], 0.02)
