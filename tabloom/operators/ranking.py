"""Metrics that need the order of the scores.

All start from one table of distinct scores with running class weights (``order.prefix_sum``):
rows are collapsed before the shuffle and no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.functions import metrics as M
from tabloom.operators.order import null_safe_join, prefix_sum, quantiles, weighted_percentile

ONE = 1.0


def class_prefix(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Distinct scores with own and running weight of positives, negatives and rows, plus totals; rows without an actual or a score don't count."""
    df = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    weight = F.col(w) if w else F.lit(ONE)
    pos = F.when(F.col(y) == 1, weight).otherwise(0.0)
    neg = F.when(F.col(y) == 1, 0.0).otherwise(weight)
    t = prefix_sum(df, p, {"pos": pos, "neg": neg, "n": F.lit(1)}, by, descending)
    tot = df.groupBy(*by).agg(F.sum(pos).alias("all_pos"), F.sum(neg).alias("all_neg"), F.count(F.lit(1)).alias("rows"))
    return null_safe_join(t, tot, list(by))


def auc(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve; a constant actual gives 1, a constant prediction 0.5."""
    t = class_prefix(df, y, p, w, by)
    below = F.col("cum_neg") - F.col("neg")
    num = F.sum(F.col("pos") * (below + 0.5 * F.col("neg")))
    pn = F.max("all_pos") * F.max("all_neg")
    return t.groupBy(*by).agg(F.when(pn == 0, 1.0).otherwise(F.try_divide(num, pn)).alias(name))


def ks(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (), name: str = "ks") -> DataFrame:
    t = class_prefix(df, y, p, w, by)
    gap = F.try_divide("cum_neg", "all_neg") - F.try_divide("cum_pos", "all_pos")
    return t.groupBy(*by).agg(F.greatest(F.max(gap), F.lit(0.0)).alias(name))


def pair_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Concordant, discordant and tied (positive, negative) pairs and Somers' D, without forming pairs."""
    t = class_prefix(df, y, p, None, by)
    conc = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg")))
    tied = F.sum(F.col("pos") * F.col("neg"))
    all_pairs = F.max("all_pos") * F.max("all_neg")
    return t.groupBy(*by).agg(
        conc.alias("concordant"), (all_pairs - conc - tied).alias("discordant"), tied.alias("tied"),
        F.try_divide(2 * conc + tied - all_pairs, all_pairs).alias("somers_d"),
    )


def gini(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (), name: str = "gini") -> DataFrame:
    """Lorenz area with rows in falling order of ``p``; equal scores are averaged, rows without an actual or a score don't count."""
    df = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    weight = F.col(w) if w else F.lit(ONE)
    t = prefix_sum(df, p, {"a": F.col(y) * weight, "k": weight}, by, descending=True)
    tot = df.groupBy(*by).agg(F.sum(F.col(y) * weight).alias("all_a"), F.sum(weight).alias("all_k"))
    t = null_safe_join(t, tot, list(by))
    a0, k0 = F.col("cum_a") - F.col("a"), F.col("cum_k") - F.col("k")
    if w:
        cross = F.sum(F.col("cum_a") * k0 - a0 * F.col("cum_k"))
        value = F.try_divide(cross, F.max("all_a") * F.max("all_k"))
    else:
        k = F.col("k")
        lorenz = F.try_divide(F.sum(k * a0 + F.col("a") * (k + 1) / 2), F.max("all_a"))
        value = (lorenz - (F.max("all_k") + 1) / 2) / F.max("all_k")
    return t.groupBy(*by).agg(value.alias(name))


def gini_norm(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (), name: str = "gini_norm") -> DataFrame:
    """Gini of the prediction over Gini of the actual itself, both of the rows that have an actual and a score."""
    df = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    own = gini(df, y, p, w, by, "_g")
    best = gini(df, y, y, w, by, "_b")
    return null_safe_join(own, best, list(by)).select(*by, F.try_divide("_g", "_b").alias(name))


def rate_at_top(df: DataFrame, y: str, p: str, share: float, w: str | None = None, by: Sequence[str] = (), name: str = "rate") -> DataFrame:
    """Mean actual among rows whose score reaches the (1 - share) percentile (weighted if ``w``)."""
    if w:
        edge = weighted_percentile(df, p, w, 1 - share).withColumnRenamed("value", "_edge")
    else:
        edge = quantiles(df, p, [1 - share], by).withColumnRenamed("q0", "_edge")
    # The edge is interpolated; the margin keeps rows equal to it inside.
    top = F.col(p) >= F.col("_edge") - 1e-12
    weight = F.col(w) if w else F.lit(ONE)
    j = null_safe_join(df, edge, [] if w else list(by))
    return j.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.when(top, F.col(y) * weight)), F.sum(F.when(top, weight))), F.lit(0.0)).alias(name))


def ams_curve(df: DataFrame, y: str, p: str, w: str | None = None) -> DataFrame:
    """Approximate median significance at selected shares 0..100 %: ``pct, ams``.

    A score joins the selection at the first share that covers all rows scoring at least as high.
    """
    t = class_prefix(df, y, p, w, descending=True)
    first = F.ceil(F.round(100 * F.col("cum_n") / F.col("rows"), 9)).cast("int")
    steps = t.groupBy(first.alias("pct")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("rows").alias("rows"))
    grid = df.sparkSession.range(0, 101).select(F.col("id").cast("int").alias("pct"))
    total = t.agg(F.max("rows").alias("_rows"), F.max("all_neg").alias("_neg"))
    upto = Window.orderBy("pct").rowsBetween(Window.unboundedPreceding, 0)  # 101 rows
    g = grid.join(steps, "pct", "left").crossJoin(F.broadcast(total))
    factor = 250000.0 / F.col("_rows")
    s = F.coalesce(F.sum("pos").over(upto), F.lit(0.0)) * factor
    b = (F.col("_neg") - F.coalesce(F.sum("neg").over(upto), F.lit(0.0))) * factor
    ams = F.sqrt(2 * ((s + b + 10.0) * F.ln(1 + s / (b + 10.0)) - s))
    return g.select("pct", ams.alias("ams"))


def ndcg(df: DataFrame, group: Sequence[str], rel: str, pred: str, k: int = 10) -> DataFrame:
    """NDCG at ``k`` per group; groups with a single grade are left out.

    Only the first ``k`` rows per group enter the sort (the rank filter runs before the shuffle);
    among equal predictions the lower grade comes first.
    """
    g = list(group)

    def dcg(order, name):
        w = Window.partitionBy(*g).orderBy(*order)
        top = df.select(*g, rel, pred).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return top.groupBy(*g).agg(F.sum((F.pow(F.lit(2.0), F.col(rel)) - 1) / F.log2(F.col("_r") + 1)).alias(name))

    grades = df.groupBy(*g).agg(F.min(rel).alias("_lo"), F.max(rel).alias("_hi")).filter("_lo < _hi").select(*g)
    a = dcg([F.desc(pred), F.asc(rel)], "_d")
    b = dcg([F.desc(rel)], "_i")
    return grades.join(a, g).join(b, g).select(*g, F.coalesce(F.try_divide("_d", "_i"), F.lit(0.0)).alias("ndcg"))


def gini_20_bins(df: DataFrame, y: str, p: str, bins: int = 20) -> DataFrame:
    """Gini from cumulative shares at 20 cut rows of the (score, target) order."""
    t = class_prefix(df, y, p)
    before = F.col("cum_n") - F.col("n")
    size = F.col("rows") / bins
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.struct(i.alias("i"), F.floor(i * size - 1).cast("long").alias("k"))
    )
    here = F.filter(cuts, lambda c: (c["k"] > before) & (c["k"] <= F.col("cum_n")))
    at = t.select("*", size.alias("size"), F.explode(here).alias("c"))
    hits = (F.col("cum_pos") - F.col("pos")) + F.greatest(F.lit(0.0), F.col("c.k") - before - F.col("neg"))
    pts = at.select(
        F.col("c.i").alias("i"), (hits / F.col("all_pos")).alias("t"), ((F.col("c.i") * F.col("size") - hits) / F.col("all_neg")).alias("u")
    )
    ends = df.sparkSession.createDataFrame([(0, 0.0, 0.0), (bins, 1.0, 1.0)], "i int, t double, u double")
    w = Window.orderBy("i")  # 21 rows
    s = pts.unionByName(ends).select(
        (F.col("t") + F.lag("t").over(w)).alias("a"), (F.col("u") - F.lag("u").over(w)).alias("b")
    )
    return s.agg((1 - F.sum(F.col("a") * F.col("b"))).alias("gini"))


def multiclass_auc(df: DataFrame, y: str, classes: Mapping[str, str]) -> DataFrame:
    """One-vs-rest AUC per class, weighted by class prevalence; ``classes``: class value -> score column."""
    cells = [F.struct(F.lit(c).alias("_class"), (F.col(y) == c).cast("int").alias("_y"), F.col(s).alias("_p")) for c, s in classes.items()]
    long = df.select(F.inline(F.array(*cells)))
    a = auc(long, "_y", "_p", None, ["_class"])
    share = long.groupBy("_class").agg(F.avg("_y").alias("_share"))
    return a.join(share, "_class").agg(F.sum(F.col("auc") * F.col("_share")).alias("auc"))


RANKED = {"AUC": auc, "Kolmogorov-Smirnov": ks, "Gini": gini, "Gini Norm": gini_norm}


def metrics_report(
    df: DataFrame, y: str, p: str, partition: str, metrics: Sequence[str], w: str | None = None, digits: int = 5
) -> DataFrame:
    """Every metric on every partition, their mean, and one pooled score: ``metric, partition, score``.

    Simple metrics share one aggregation over partitions and pool; each rank metric is one pass over
    running class counts.  A score that is not finite raises when the row is produced.
    """
    both = df.withColumn("_part", F.explode(F.array(F.col(partition).cast("string"), F.lit("pooled"))))
    weight = F.col(w) if w else None
    simple = [m for m in metrics if m in M.SIMPLE]
    out = None
    if simple:
        g = both.groupBy("_part").agg(*[M.SIMPLE[m](F.col(y), F.col(p), weight).alias(m) for m in simple])
        out = g.unpivot(["_part"], simple, "metric", "score")
    for m in metrics:
        if m in RANKED:
            r = RANKED[m](both, y, p, w, ["_part"], "score").select("_part", F.lit(m).alias("metric"), "score")
            out = r if out is None else out.unionByName(r)
    fold_mean = out.filter("_part <> 'pooled'").groupBy("metric").agg(F.avg("score").alias("score")).withColumn("_part", F.lit("mean"))
    out = out.unionByName(fold_mean)
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    score = F.when(bad, F.raise_error(F.concat(F.lit("not finite: "), F.col("metric")))).otherwise(F.round("score", digits))
    return out.select("metric", F.col("_part").alias("partition"), score.alias("score"))
