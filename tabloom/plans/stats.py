"""Statistical tests."""

from pyspark.sql import functions as F

from tabloom.operators import stats as K
from tabloom.operators.sampling import POISSON_CUTS
from tabloom.plans.fixtures import V_SCORES
from tabloom.plans.registry import query

X = ["l_quantity", "l_discount", "l_tax"]


@query(
    "K01_ols",
    """with f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, count(*) as n, regr_r2(l_extendedprice, l_quantity) as r2, regr_syy(l_extendedprice, l_quantity) as tss from lineitem)
    select 'const' as term, round(a, 3) as coef, n::int as n, round(r2, 3) as r2 from f union all select 'l_quantity', round(b, 3), n::int, round(r2, 3) from f""",
    digits=3,
)
def k01(t):
    return K.ols_table(t.lineitem, "l_extendedprice", ["l_quantity"]).drop("rss")


@query(
    "K02_vif",
    """with c as (select corr(l_quantity, l_extendedprice) ** 2 as r2 from lineitem) select 'l_quantity' as feature, round(1 / (1 - r2), 5) as vif, round(r2, 5) as r2 from c
    union all select 'l_extendedprice', round(1 / (1 - r2), 5), round(r2, 5) from c""",
    digits=5,
)
def k02(t):
    return K.vif(t.lineitem, ["l_quantity", "l_extendedprice"])


@query("K03_condition_number")
def k03(t):
    return K.condition_number(t.lineitem, X)


@query(
    "K04_chow_test",
    """with s as (select l_orderkey < 5000 as side, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) as rss, count(*) as n from lineitem group by 1),
    a as (select regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) as rss from lineitem)
    select round(((select rss from a) - sum(rss)) / 2 / (sum(rss) / (sum(n) - 4)), 4) as f, 2 as df1, (sum(n) - 4)::int as df2 from s""",
    digits=4,
)
def k04(t):
    return K.chow_test(t.lineitem, "l_extendedprice", ["l_quantity"], F.col("l_orderkey") < 5000)


@query("K05_reset_test")
def k05(t):
    return K.reset_test(t.lineitem, "l_extendedprice", X)


@query(
    "K05_reset_one",
    """with d as (select l_quantity - avg(l_quantity) over () as x, l_extendedprice - avg(l_extendedprice) over () as y from lineitem),
    m as (select regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_slope(x * x, x) as b2, regr_intercept(x * x, x) as a2, count(*) as n from d),
    s as (select sum((y - a - b * x) ** 2) as rss, sum((y - a - b * x) * (x * x - a2 - b2 * x)) as eq, sum((x * x - a2 - b2 * x) ** 2) as qq, max(n) as n from d, m)
    select round((eq * eq / qq) / ((rss - eq * eq / qq) / (n - 3)), 4) as f, 1 as df1, (n - 3)::int as df2 from s""",
    digits=4,
)
def k05b(t):
    """One regressor and the square of the fit, whose twin takes the square's residual out of the first one's."""
    return K.reset_test(t.lineitem, "l_extendedprice", ["l_quantity"], 2)


@query("K06_breusch_pagan")
def k06(t):
    return K.heteroscedasticity(t.lineitem, "l_extendedprice", X)


@query("K06_white")
def k06b(t):
    return K.heteroscedasticity(t.lineitem, "l_extendedprice", X, white=True)


@query("K07_anderson_darling")
def k07(t):
    return K.anderson_darling(t.lineitem, ["l_quantity", "l_extendedprice"])


@query(
    "K08_ks_two_sample",
    """with d as (select l_extendedprice as v, sum((l_linestatus = 'F')::int) as a, sum((l_linestatus = 'O')::int) as b from lineitem group by 1)
    select round(max(g), 6) as ks from (select abs(sum(a) over (order by v) / sum(a) over () - sum(b) over (order by v) / sum(b) over ()) as g from d)""",
)
def k08(t):
    return K.ks_two_sample(t.lineitem.filter("l_linestatus = 'F'"), t.lineitem.filter("l_linestatus = 'O'"), "l_extendedprice")


def woe_sql(feature, level):
    return f"select '{feature}' as feature, {level} as level, sum(y)::bigint as events, sum(1 - y)::bigint as non_events from li group by 2"


def bins5(c):
    return "cast(1 + " + " + ".join(f"({c} >= (select quantile_cont({c}, {p}) from lineitem))::int" for p in (0.2, 0.4, 0.6, 0.8)) + " as varchar)"


@query(
    "K09_woe_iv",
    f"""with li as (select *, (l_returnflag = 'R')::int as y from lineitem), g as ({woe_sql('l_quantity', bins5('l_quantity'))} union all {woe_sql('l_extendedprice', bins5('l_extendedprice'))} union all {woe_sql('l_linestatus', 'l_linestatus')}),
    s as (select *, events / sum(events) over (partition by feature) as pe, non_events / sum(non_events) over (partition by feature) as pn from g), w as (select *, case when pe = 0 then -20 when pn = 0 then 20 else ln(pe / pn) end as w from s)
    select feature, level, events, non_events, round(w, 6) + 0 as woe, round(sum((pe - pn) * w) over (partition by feature), 6) + 0 as iv from w""",
)
def k09(t):
    d = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return K.woe_iv(d, "y", ["l_quantity", "l_extendedprice"], ["l_linestatus"])


@query(
    "K10_categorical_iv",
    """with g as (select l_linestatus, sum((l_returnflag <> 'R')::int)::bigint as good, sum((l_returnflag = 'R')::int)::bigint as bad from lineitem group by 1), s as (select *, good / sum(good) over () as a, bad / sum(bad) over () as b from g)
    select l_linestatus, good, bad, round(ln(a / b), 8) + 0 as woe, round((a - b) * ln(a / b), 8) + 0 as iv from s""",
    digits=8,
)
def k10(t):
    return K.categorical_iv(t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "l_linestatus", "y")


@query(
    "K11_ngram_lift",
    """with h as (select distinct p_name as term, p_type as cl, p_partkey as doc from part), i as (select term, cl, count(*) as a from h group by 1, 2), z as (select cl, count(distinct p_partkey) as na from (select p_type as cl, p_partkey from part) group by 1),
    j as (select term, cl, a, na, (sum(a) over (partition by term) - a)::bigint as b, (select count(*) from part) - na as nb from i join z using (cl))
    select term, cl, a, na, b, nb, round(a / na / ((b + 10) / nb), 6) as lift, round((na + nb) * (a * (nb - b) - b * (na - a))::double ** 2 / (na::double * nb * (a + b) * (na + nb - a - b)), 6) as chi2 from j""",
)
def k11(t):
    return K.ngram_lift(t.part.select(F.col("p_name").alias("term"), F.col("p_type").alias("cl"), F.col("p_partkey").alias("doc")), "term", "cl", "doc")


@query(
    "K12_adjusted_rand",
    """with c as (select o_orderstatus as a, o_orderpriority as b, count(*)::double as n from orders group by 1, 2), s as (select (select sum(n * (n - 1) / 2) from c) as ij, (select sum(k * (k - 1) / 2) from (select sum(n) as k from c group by a)) as i,
      (select sum(k * (k - 1) / 2) from (select sum(n) as k from c group by b)) as j, (select sum(n) from c) as n)
    select round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 8) + 0 as ari from s""",
    digits=8,
)
def k12(t):
    return K.adjusted_rand(t.orders, "o_orderstatus", "o_orderpriority")


@query(
    "K13_bootstrap_ci_draw",
    f"""with r as (select o_totalprice as v, r, ((o_orderkey * 7919 + r * 104729) % 10007) / 10007.0::double as u from orders, (select unnest(range(1, 51)) as r)),
    c as (select *, case {" ".join(f"when u < {c!r} then {i}" for i, c in enumerate(POISSON_CUTS))} else {len(POISSON_CUTS)} end as copies from r),
    m as (select r, sum(copies * v) / sum(copies) as m from c group by 1) select round(quantile_cont(m, 0.025), 4) as lower, round(quantile_cont(m, 0.975), 4) as upper, round(avg(m), 4) as mean, round(stddev_samp(m), 4) as sd from m""",
    digits=4,
)
def k13b(t):
    """Replicates drawn by numbers that SQL repeats."""
    u = ((F.col("o_orderkey") * 7919 + F.col("replicate") * 104729) % 10007) / F.lit(10007.0)
    return K.bootstrap_ci(t.orders, ["o_orderkey"], "o_totalprice", 50, draw=u)


@query("K13_bootstrap_ci")
def k13(t):
    return K.bootstrap_ci(t.events, ["event_id"], "value", 100)


@query("K14_influence")
def k14(t):
    return K.influence(t.lineitem.select("l_orderkey", "l_extendedprice", *X), "l_extendedprice", X)


@query(
    "K15_rank_sum",
    """with d as (select l_quantity as v, count(*) as n, sum((l_returnflag = 'R')::int) as g from lineitem group by 1), r as (select *, sum(n) over (order by v) - (n - 1) / 2 as mid from d),
    s as (select sum(mid * g) as w, sum(g)::double as a, sum(n)::double as n, sum(n::double ** 3 - n) as ties from r), u as (select *, w - a * (a + 1) / 2 as u, n - a as b from s)
    select u, round((u - a * b / 2) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))), 6) + 0 as z from u""",
)
def k15(t):
    return K.rank_sum(t.lineitem, "l_quantity", F.col("l_returnflag") == "R")


@query(
    "K15_rank_sum_p",
    """with x as (select p_retailprice as v, (p_brand = (select min(p_brand) from part))::int as g from part), d as (select v, count(*) as n, sum(g) as g from x group by 1), r as (select *, sum(n) over (order by v) - (n - 1) / 2 as mid from d),
    s as (select sum(mid * g) as w, sum(g)::double as a, sum(n)::double as n, sum(n::double ** 3 - n) as ties from r), u as (select *, w - a * (a + 1) / 2 as u, n - a as b from s),
    z as (select u, (u - a * b / 2) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) as z from u), w as (select unnest(range(0, 4001)) as i)
    select u, round(z, 6) + 0 as z, round((select 0.5 - z / 4000 / 3 * sum(exp(-0.5 * (z * i / 4000) ** 2) * case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) / sqrt(2 * pi()) from w), 6) + 0 as p from z""",
)
def k15b(t):
    """One-sided: are the parts of the first brand dearer; the twin integrates the density by Simpson's rule."""
    first = t.part.agg(F.min("p_brand").alias("first"))
    return K.rank_sum(t.part.crossJoin(F.broadcast(first)), "p_retailprice", F.col("p_brand") == F.col("first"), "greater")


ONE = """m as (select avg(l_quantity) as mx, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, regr_sxx(l_extendedprice, l_quantity) as sxx,
    regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) as rss, count(*) as n from lineitem)"""


@query(
    "K03_condition_number_one",
    """with s as (select count(*)::double as n, sum(l_quantity) / sqrt(sum(l_quantity * l_quantity)) as g from lineitem), e as (select (n + 1) / 2 as h, sqrt(((n - 1) / 2) ** 2 + g * g) as d from s)
    select round(sqrt((h + d) / (h - d)), 3) as condition_number from e""",
    digits=3,
)
def k03b(t):
    return K.condition_number(t.lineitem, ["l_quantity"])


@query(
    "K06_breusch_pagan_one",
    f"""with {ONE}, r as (select (l_extendedprice - a - b * l_quantity) ** 2 / (rss / n) as e, l_quantity as x from lineitem, m) select round(count(*) * regr_r2(e, x), 4) as lm, 1 as dof from r""",
    digits=4,
)
def k06c(t):
    return K.heteroscedasticity(t.lineitem, "l_extendedprice", ["l_quantity"])


@query(
    "K14_influence_one",
    f"""with {ONE}, r as (select l_orderkey, l_quantity, l_extendedprice, n, rss, l_extendedprice - a - b * l_quantity as e, 1 / n + (l_quantity - mx) ** 2 / sxx as h from lineitem, m),
    q as (select *, e / sqrt((rss - e * e / (1 - h)) / (n - 3) * (1 - h)) * sqrt(h / (1 - h)) as d from r)
    select l_orderkey, l_quantity, l_extendedprice, round(h, 8) as leverage, round(e, 1) + 0 as residual, round(e / (1 - h), 1) + 0 as press, round(e / sqrt(rss / (n - 2) * (1 - h)), 4) + 0 as studentised, round(d, 5) + 0 as dffits,
      abs(d) > 2 * sqrt(2 / n) as influential from q""",
    digits=8,
)
def k14b(t):
    i = K.influence(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), "l_extendedprice", ["l_quantity"])
    return i.withColumns({c: F.round(c, d) for c, d in (("residual", 1), ("press", 1), ("studentised", 4), ("dffits", 5))})
