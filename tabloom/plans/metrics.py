"""Evaluation metrics."""

from pyspark.sql import functions as F

from tabloom.functions import metrics as M
from tabloom.operators import ranking as K, sets as U

from tabloom.plans.fixtures import V_SCORES, V_SERIES
from tabloom.plans.registry import query



def cols():
    return F.col("y"), F.col("p"), F.col("w"), F.col("actual"), F.col("pred")


def by_group(t, **aggs):
    return t.scores.groupBy("grp").agg(*[c.alias(n) for n, c in aggs.items()])


LL = "-(y * ln(p) + (1 - y) * ln(1 - p))"


@query("M01_logloss", f"with {V_SCORES} select grp, round(avg({LL}), 6) as plain, round(sum(w * {LL}) / sum(w), 6) as weighted from v_scores group by 1")
def m01(t):
    y, p, w, *_ = cols()
    return by_group(t, plain=M.logloss(y, p), weighted=M.logloss(y, p, w))


PROBS = "case flag when 'R' then p / 2 when 'A' then (1 - p) / 2 else 0.5 end"


@query("M02_multiclass_logloss", f"with {V_SCORES} select grp, round(avg(-ln({PROBS})), 6) as score from v_scores group by 1")
def m02(t):
    p = F.col("p")
    probs = F.create_map(F.lit("R"), p / 2, F.lit("A"), (1 - p) / 2, F.lit("N"), F.lit(0.5))
    return by_group(t, score=M.multiclass_logloss(F.element_at(probs, F.col("flag"))))


@query(
    "M03_logloss_logits",
    f"""with {V_SCORES}, s as (select grp, 1 / (1 + exp(-y)) as y, 1 / (1 + exp(-p)) as p from v_scores) select grp, round(avg({LL}), 6) as score from s group by 1""",
)
def m03(t):
    y, p, *_ = cols()
    return by_group(t, score=M.logloss_logits(y, p))


@query(
    "M04_accuracy",
    f"""with {V_SCORES}, s as (select *, round_even(p, 0) = y as hit from v_scores) select grp, round(avg(hit::int), 6) as accuracy,
    round((avg(hit::int) filter (where y = 1) + avg(hit::int) filter (where y = 0)) / 2, 6) as balanced from s group by 1""",
)
def m04(t):
    y, p, *_ = cols()
    return by_group(t, accuracy=M.accuracy(y, p), balanced=M.balanced_accuracy(y, p))


D = "d as (select grp, p, sum(case when y = 1 then {w} else 0 end) as pos, sum(case when y = 0 then {w} else 0 end) as neg from v_scores group by 1, 2), c as (select *, sum(neg) over (partition by grp order by p) - neg as below, sum(pos) over (partition by grp) as tp, sum(neg) over (partition by grp) as tn, sum(pos) over (partition by grp order by p) as cp, sum(neg) over (partition by grp order by p) as cn from d)"


@query(
    "M05_auc",
    f"""with {V_SCORES}, {D.format(w='1')}, a as (select grp, sum(pos * (below + 0.5 * neg)) / max(tp * tn) as auc from c group by 1) select grp, round(auc, 6) as auc from a""",
)
def m05(t):
    return K.auc(t.scores, "y", "p", by=["grp"])


@query("M05_auc_weighted", f"with {V_SCORES}, {D.format(w='w')} select grp, round(sum(pos * (below + 0.5 * neg)) / max(tp * tn), 6) as auc from c group by 1")
def m05b(t):
    return K.auc(t.scores, "y", "p", "w", by=["grp"])


def ovr(flag, score):
    return f"""select '{flag}' as k, avg((flag = '{flag}')::int) as share,
    (select sum(pos * (cn - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) from (select s, sum((flag = '{flag}')::int)::double as pos, sum((flag <> '{flag}')::int)::double as neg,
      sum(sum((flag <> '{flag}')::int)) over (order by s) as cn from (select flag, {score} as s from v_scores) group by 1)) as auc from v_scores"""


@query(
    "M06_multiclass_auc",
    f"with {V_SCORES}, o as ({ovr('R', 'p')} union all {ovr('A', '1 - p')} union all {ovr('N', 'w')}) select round(sum(share * auc), 6) as auc from o",
)
def m06(t):
    s = t.scores.select("flag", F.col("p").alias("pr"), (1 - F.col("p")).alias("pa"), F.col("w").alias("pn"))
    return K.multiclass_auc(s, "flag", {"R": "pr", "A": "pa", "N": "pn"})


@query("M07_ks", f"with {V_SCORES}, {D.format(w='1')} select grp, round(greatest(max(cn / tn - cp / tp), 0), 6) as ks from c group by 1")
def m07(t):
    return K.ks(t.scores, "y", "p", by=["grp"])


def gini_sql(order, w=False):
    if w:
        return f"""(select sum(ca * (ck - k) - (ca - a) * ck) / (max(ta) * max(tk)) from (select a, k, sum(a) over (order by o desc) as ca, sum(k) over (order by o desc) as ck,
          sum(a) over () as ta, sum(k) over () as tk from (select {order} as o, sum(actual * w) as a, sum(w) as k from v_scores group by 1)))"""
    return f"""(select (sum(k * (ca - a) + a * (k + 1) / 2) / max(ta) - (max(tk) + 1) / 2) / max(tk) from (select a, k, sum(a) over (order by o desc) as ca,
      sum(a) over () as ta, sum(k) over () as tk from (select {order} as o, sum(actual) as a, count(*)::double as k from v_scores group by 1)))"""


@query("M08_gini", f"with {V_SCORES} select round({gini_sql('pred')}, 6) as gini, round({gini_sql('pred', True)}, 6) as gini_w")
def m08(t):
    return K.gini(t.scores, "actual", "pred").crossJoin(K.gini(t.scores, "actual", "pred", "w", name="gini_w"))


@query("M09_gini_norm", f"with {V_SCORES} select round({gini_sql('pred')} / {gini_sql('actual')}, 6) as gini_norm")
def m09(t):
    return K.gini_norm(t.scores, "actual", "pred")


SOME_NULL = f"""with {V_SCORES.replace('v_scores as', 'v_base as')}, v_scores as (select * replace (case when l_orderkey % 7 = 0 then null else actual end as actual), case when l_orderkey % 11 = 0 then null else pred end as pred_ from v_base),
    v_full as (select * replace (pred_ as pred) from v_scores where actual is not null and pred_ is not null)"""


@query(
    "M08_gini_nulls",
    f"{SOME_NULL} select round({gini_sql('pred').replace('v_scores', 'v_full')}, 6) as gini, round({gini_sql('pred', True).replace('v_scores', 'v_full')}, 6) as gini_w, round({gini_sql('pred').replace('v_scores', 'v_full')} / {gini_sql('actual').replace('v_scores', 'v_full')}, 6) as gini_norm",
)
def m08b(t):
    """Rows without an actual or without a score are left out of sums, weights and totals."""
    some = t.scores.withColumns({"actual": F.when(F.col("l_orderkey") % 7 != 0, F.col("actual")), "pred": F.when(F.col("l_orderkey") % 11 != 0, F.col("pred"))})
    return K.gini(some, "actual", "pred").crossJoin(K.gini(some, "actual", "pred", "w", name="gini_w")).crossJoin(K.gini_norm(some, "actual", "pred"))


@query("M10_mean_separation", f"with {V_SCORES} select grp, round(avg(p) filter (where y = 1) - avg(p) filter (where y = 0), 6) + 0 as score from v_scores group by 1")
def m10(t):
    y, p, *_ = cols()
    return by_group(t, score=M.mean_separation(y, p))


@query(
    "M11_rate_at_top",
    f"with {V_SCORES} " + " union all ".join(
        f"select {s}::double as share, round(avg(y), 6) as rate from v_scores where p >= (select quantile_cont(p, {1 - s}) from v_scores) - 1e-12"
        for s in (0.1, 0.05, 0.001)
    ),
)
def m11(t):
    out = None
    for s in (0.1, 0.05, 0.001):
        r = K.rate_at_top(t.scores, "y", "p", s).withColumn("share", F.lit(s))
        out = r if out is None else out.unionByName(r)
    return out


@query(
    "M11_rate_at_top_weighted",
    f"""with {V_SCORES}, d as (select p, sum(w) as w from v_scores group by 1), s as (select p, sum(w) over (order by p) / sum(w) over () as s from d),
    e as (select max(s) filter (where s <= 0.9) as slo, max(p) filter (where s <= 0.9) as plo, min(s) filter (where s > 0.9) as shi, min(p) filter (where s > 0.9) as phi from s),
    x as (select plo + (0.9 - slo) * (phi - plo) / (shi - slo) as edge from e) select round(sum(y * w) / sum(w), 6) as rate from v_scores, x where p >= edge - 1e-12""",
)
def m11b(t):
    return K.rate_at_top(t.scores, "y", "p", 0.1, "w")


@query(
    "M12_ams",
    f"""with {V_SCORES}, d as (select p, sum(y) as pos, sum(1 - y) as neg, count(*) as n from v_scores group by 1),
    c as (select *, ceil(round(100 * sum(n) over (order by p desc) / sum(n) over (), 9))::int as pct from d), tot as (select count(*) as rows, sum(1 - y) as tn from v_scores),
    g as (select unnest(range(0, 101))::int as pct), z as (select g.pct, coalesce(sum(pos), 0) * 250000.0::double / max(rows) as s, (max(tn) - coalesce(sum(neg), 0)) * 250000.0::double / max(rows) as b
      from g cross join tot left join c on c.pct <= g.pct group by 1)
    select pct, round(sqrt(2 * ((s + b + 10) * ln(1 + s / (b + 10)) - s)), 6) as ams from z""",
)
def m12(t):
    return K.ams_curve(t.scores, "y", "p")


@query(
    "M13_r_squared",
    f"""with {V_SCORES}, m as (select grp, avg(actual) as a, sum(w * actual) / sum(w) as aw from v_scores group by 1)
    select grp, round(1 - sum((actual - pred) ** 2) / sum((actual - a) ** 2), 6) as plain, round(1 - sum(w * (actual - pred) ** 2) / sum(w * (actual - aw) ** 2), 6) as weighted
    from v_scores join m using (grp) group by 1""",
)
def m13(t):
    _, _, w, a, e = cols()
    return by_group(t, plain=M.r_squared(a, e), weighted=M.r_squared(a, e, w))


@query(
    "M14_rmse_mae",
    f"""with {V_SCORES} select grp, round(sqrt(avg((actual - pred) ** 2)), 4) as rmse, round(avg(abs(actual - pred)), 4) as mae,
    round(sqrt(sum(w * (actual - pred) ** 2) / sum(w)), 4) as rmse_w, round(sum(w * abs(actual - pred)) / sum(w), 4) as mae_w from v_scores group by 1""",
    digits=4,
)
def m14(t):
    _, _, w, a, e = cols()
    return by_group(t, rmse=M.rmse(a, e), mae=M.mae(a, e), rmse_w=M.rmse(a, e, w), mae_w=M.mae(a, e, w))


@query(
    "M15_coldstart",
    f"""with {V_SCORES}, train as (select distinct l_partkey, l_suppkey from v_scores where grp = 'O'), s as (select actual, pred, case when t.l_partkey is null then 1 else 0 end as cw
      from v_scores v left join train t on v.l_partkey = t.l_partkey and v.l_suppkey = t.l_suppkey where grp = 'F')
    select sum(cw)::bigint as cold_rows, round(sqrt(sum(cw * (actual - pred) ** 2) / sum(cw)), 4) as rmse, round(sum(cw * abs(actual - pred)) / sum(cw), 4) as mae from s""",
    digits=4,
)
def m15(t):
    s = U.coldstart_weights(t.scores.filter("grp = 'F'"), t.scores.filter("grp = 'O'"), ["l_partkey", "l_suppkey"])
    a, e, w = F.col("actual"), F.col("pred"), F.col("weight")
    return s.agg(F.sum(w).alias("cold_rows"), M.rmse(a, e, w).alias("rmse"), M.mae(a, e, w).alias("mae"))


@query(
    "M16_per_user_error",
    f"""with {V_SCORES}, u as (select l_suppkey, sqrt(avg((actual - pred) ** 2)) as r, avg(abs(actual - pred)) as m from v_scores group by 1)
    select round(avg(r), 4) as rmse, round(avg(m), 4) as mae, count(*) as users from u""",
    digits=4,
)
def m16(t):
    _, _, _, a, e = cols()
    u = t.scores.groupBy("l_suppkey").agg(M.rmse(a, e).alias("r"), M.mae(a, e).alias("m"))
    return u.agg(F.avg("r").alias("rmse"), F.avg("m").alias("mae"), F.count(F.lit(1)).alias("users"))


@query("M17_rmsle", f"with {V_SCORES} select grp, round(sqrt(avg((ln(1 + actual) - ln(1 + greatest(pred - 9000, 0))) ** 2)), 6) as score from v_scores group by 1")
def m17(t):
    _, _, _, a, e = cols()
    return by_group(t, score=M.rmsle(a, e - 9000))


Q = "l as (select grp, w, case when flag = 'A' then 0 else actual / 1000 end as a, greatest((pred - 9000) / 1000, {f}) as q, greatest(case when flag = 'A' then 0 else actual / 1000 end, {f}) as af from v_scores)"


def dev_inputs(t):
    a = F.when(F.col("flag") == "A", 0.0).otherwise(F.col("actual") / 1000)
    return t.scores.select("grp", "w", a.alias("a"), ((F.col("pred") - 9000) / 1000).alias("q"))


PD = "case when a = 0 then 2 * q else 2 * (a * ln(a / q) - (a - q)) end"


@query("M18_poisson_deviance", f"with {V_SCORES}, {Q.format(f='1e-8::double')} select grp, round(avg({PD}), 6) as plain, round(sum(w * {PD}) / sum(w), 6) as weighted from l group by 1")
def m18(t):
    a, q, w = F.col("a"), F.col("q"), F.col("w")
    return dev_inputs(t).groupBy("grp").agg(M.poisson_deviance(a, q).alias("plain"), M.poisson_deviance(a, q, w).alias("weighted"))


TD = "2 * (a ** 0.5 / ((1 - 1.5) * (2 - 1.5)) - a * q ** (1 - 1.5) / (1 - 1.5) + q ** 0.5 / (2 - 1.5))"


@query("M19_tweedie_deviance", f"with {V_SCORES}, {Q.format(f='1e-3::double')} select grp, round(avg({TD}), 6) as score from l group by 1")
def m19(t):
    return dev_inputs(t).groupBy("grp").agg(M.tweedie_deviance(F.col("a"), F.col("q"), floor=1e-3).alias("score"))


GD = "2 * (-ln(af / q) + (af - q) / q)"


@query("M20_gamma_deviance", f"with {V_SCORES}, {Q.format(f='0.01::double')} select grp, round(avg({GD}), 6) as score from l group by 1")
def m20(t):
    return dev_inputs(t).groupBy("grp").agg(M.gamma_deviance(F.col("a"), F.col("q")).alias("score"))


@query(
    "M21_fve",
    f"""with {V_SCORES}, m as (select grp, avg(y) as y0, avg(actual) as a0 from v_scores group by 1), x as (select grp, y, p, y0, actual / 1000 as a, pred / 1000 as q, a0 / 1000 as m from v_scores join m using (grp))
    select grp, round(1 - avg({LL}) / avg({LL.replace('p)', 'y0)')}), 6) as binomial,
    round(1 - avg({PD}) / avg({PD.replace('q', 'm')}), 6) as poisson, round(1 - avg({TD}) / avg({TD.replace('q', 'm')}), 6) as tweedie,
    round(1 - avg({GD.replace('af', 'a')}) / avg({GD.replace('af', 'a').replace('q', 'm')}), 6) as gamma from x group by 1""",
)
def m21(t):
    y, p, _, a, e = cols()
    a, e = a / 1000, e / 1000
    return by_group(t, binomial=M.fve_binomial(y, p), poisson=M.fve_poisson(a, e), tweedie=M.fve_tweedie(a, e), gamma=M.fve_gamma(a, e))


@query("M22_mape", f"with {V_SCORES} select grp, round(100 * avg(abs(actual - pred) / actual), 6) as score from v_scores group by 1")
def m22(t):
    _, _, _, a, e = cols()
    return by_group(t, score=M.mape(a, e))


@query(
    "M23_mape_signed",
    f"""with {V_SCORES}, x as (select grp, case when l_suppkey % 5 = 0 then 0 else actual end as a, pred as p from v_scores)
    select grp, round(avg(abs(a - p) / nullif(a, 0)), 6) as dropped, round(avg(coalesce(abs(a - p) / nullif(a, 0), 0)), 6) as zeroed from x group by 1""",
)
def m23(t):
    a = F.when(F.col("l_suppkey") % 5 == 0, 0.0).otherwise(F.col("actual"))
    return by_group(t, dropped=M.mape_signed(a, F.col("pred")), zeroed=M.mape_signed(a, F.col("pred"), True))


@query("M24_smape", f"with {V_SCORES} select grp, round(avg(abs(pred - actual) / ((abs(actual) + abs(pred)) / 2)), 6) as score from v_scores group by 1")
def m24(t):
    _, _, _, a, e = cols()
    return by_group(t, score=M.smape(a, e))


@query(
    "M25_ndcg",
    f"""with {V_SCORES}, g as (select l_suppkey, (l_partkey % 4)::int as rel, p from v_scores), r as (select *, row_number() over (partition by l_suppkey order by p desc, rel) as a,
      row_number() over (partition by l_suppkey order by rel desc) as b from g)
    select l_suppkey, round(sum((2 ** rel - 1) / log2(a + 1)) filter (where a <= 10) / sum((2 ** rel - 1) / log2(b + 1)) filter (where b <= 10), 6) as ndcg
    from r group by 1 having min(rel) < max(rel)""",
)
def m25(t):
    return K.ndcg(t.scores.withColumn("rel", (F.col("l_partkey") % 4).cast("int")), ["l_suppkey"], "rel", "p", 10)


@query(
    "M26_somers_d",
    f"""with {V_SCORES}, {D.format(w='1')}, s as (select grp, sum(pos * below)::double as c, sum(pos * neg)::double as t, max(tp * tn)::double as a from c group by 1)
    select grp, c as concordant, a - c - t as discordant, t as tied, round((2 * c + t - a) / a, 6) + 0 as somers_d from s""",
)
def m26(t):
    return K.pair_counts(t.scores, "y", "p", ["grp"])


@query(
    "M27_gini_20_bins",
    f"""with {V_SCORES}, o as (select y, row_number() over (order by p, y) as r from v_scores), n as (select count(*) as n, sum(y) as tp, sum(1 - y) as tn from v_scores),
    b as (select i, floor(i * n / 20 - 1)::bigint as k, i * n / 20 as pos, tp, tn from n, (select unnest(range(1, 20)) as i)),
    h as (select i, pos, tp, tn, coalesce(sum(y), 0) as hits from b left join o on r <= k group by all),
    pts as (select i, hits / tp as t, (pos - hits) / tn as u from h union all select 0, 0, 0 union all select 20, 1, 1)
    select round(1 - sum(a * b), 6) + 0 as gini from (select t + lag(t) over (order by i) as a, u - lag(u) over (order by i) as b from pts)""",
)
def m27(t):
    return K.gini_20_bins(t.scores, "y", "p")


@query(
    "M28_normalized_score",
    f"""with {V_SCORES}, m as (select *, avg(y) over (partition by grp) as y0, avg(actual) over (partition by grp) as a0 from v_scores),
    s as (select grp, 'LogLoss' as metric, avg({LL}) as score, avg({LL.replace('p)', 'y0)')}) as null_score from m group by 1
      union all select grp, 'RMSE', sqrt(avg((actual - pred) ** 2)), sqrt(avg((actual - a0) ** 2)) from m group by 1
      union all select grp, 'MAPE', 100 * avg(abs(actual - pred) / actual), 100 * avg(abs(actual - a0) / actual) from m group by 1
      union all select grp, 'Accuracy', avg((round_even(p, 0) = y)::int), 0.5 from m group by 1)
    select grp, metric, round(case metric when 'Accuracy' then score when 'MAPE' then 2 / (1 + exp(-0.1 * (null_score / greatest(0.001, score) - 1))) - 1 else 1 - score / null_score end, 6) + 0 as score from s""",
)
def m28(t):
    from tabloom.operators.order import group_transform

    y, p, _, a, e = cols()
    m = group_transform(t.scores, ["grp"], {"y0": F.avg("y"), "a0": F.avg("actual")}, few=True)
    pairs = {
        "LogLoss": (M.logloss(y, p), M.logloss(y, F.col("y0"))),
        "RMSE": (M.rmse(a, e), M.rmse(a, F.col("a0"))),
        "MAPE": (M.mape(a, e), M.mape(a, F.col("a0"))),
        "Accuracy": (M.accuracy(y, p), F.max(F.lit(0.5))),
    }
    cells = [F.struct(F.lit(k).alias("metric"), F.lit(M.FAMILIES[k]).alias("family"), s.alias("s"), n.alias("z")) for k, (s, n) in pairs.items()]
    g = m.groupBy("grp").agg(F.array(*cells).alias("c")).select("grp", F.inline("c"))
    return g.select("grp", "metric", M.normalized_score(F.col("family"), F.col("s"), F.col("z")).alias("score"))


@query(
    "M29_metrics_report",
    f"""with {V_SCORES.replace('v_scores as', 'v_base as')}, v_scores as (select p, y, w, grp from v_base union all select p, y, w, 'pooled' from v_base), {D.format(w='1')},
    s as (select grp, 'LogLoss' as metric, avg({LL}) as score from v_scores group by 1 union all select grp, 'RMSE', sqrt(avg((y - p) ** 2)) from v_scores group by 1
      union all select grp, 'AUC', sum(pos * (below + 0.5 * neg)) / max(tp * tn) from c group by 1 union all select grp, 'Kolmogorov-Smirnov', greatest(max(cn / tn - cp / tp), 0) from c group by 1)
    select metric, grp as partition, round(score, 5) as score from s union all select metric, 'mean', round(avg(score), 5) from s where grp <> 'pooled' group by 1""",
    digits=5,
)
def m29(t):
    return K.metrics_report(t.scores, "y", "p", "grp", ["LogLoss", "RMSE", "AUC", "Kolmogorov-Smirnov"])


@query(
    "M30_scaled_errors",
    f"""with {V_SERIES}, d as (select series_id, target as y, lag(target) over w as prev, lag(target, 7) over w as pred from v_series window w as (partition by series_id order by date))
    select series_id, round(sqrt(avg((y - pred) ** 2)) / sqrt(avg((y - prev) ** 2)), 6) as rmse_scaled, round(median(abs(y - pred)) / median(abs(y - prev)), 6) as mad_scaled from d group by 1""",
)
def m30(t):
    from tabloom.operators.windows import lag_lead

    d = lag_lead(t.series, ["series_id"], "date", "target", [1, 7])
    y, prev, pred = F.col("target"), F.col("target_lag_1"), F.col("target_lag_7")
    return d.groupBy("series_id").agg(
        F.try_divide(M.rmse(y, pred), M.rmse(y, prev)).alias("rmse_scaled"),
        F.try_divide(F.median(F.abs(y - pred)), F.median(F.abs(y - prev))).alias("mad_scaled"),
    )


@query("M31_separation_spread", f"with {V_SCORES} select grp, round(min(p) filter (where y = 1) - max(p) filter (where y = 0), 6) as score from v_scores group by 1")
def m31(t):
    y, p, *_ = cols()
    return by_group(t, score=M.separation_spread(y, p))
