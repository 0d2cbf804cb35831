"""Lift, thresholds, pay-offs, quotas and tiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.operators.order import null_safe_join, prefix_sum, qcut, row_positions, weighted_qcut
from tabloom.operators.ranking import class_prefix
from tabloom.operators.reshape import weighted_mean
from tabloom.session import materialize


def lift_table(df: DataFrame, y: str, p: str, bins: int, w: str | None = None) -> DataFrame:
    """Mean prediction and actual per (weighted) quantile bin, bins renumbered 1..n."""
    b = weighted_qcut(df, p, w, bins, "_bin") if w else qcut(df, p, bins, "_bin", "drop")
    weight = F.col(w) if w else F.lit(1.0)
    g = b.groupBy("_bin").agg(
        weighted_mean(F.col(p), weight).alias("mean_pred"), weighted_mean(F.col(y), weight).alias("mean_actual"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.withColumn("bin", F.row_number().over(Window.orderBy("_bin"))).drop("_bin")  # <= bins rows


def roc_points(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score used as threshold (positive if score >= threshold)."""
    t = class_prefix(df.filter(F.col(y).isNotNull()), y, p, None, by, descending=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn, tn = F.col("all_pos") - tp, F.col("all_neg") - fp
    return t.select(
        *by, F.col(p).alias("threshold"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        F.try_divide(tp, "all_pos").alias("tpr"), F.try_divide(fp, "all_neg").alias("fpr"),
    )


def f_beta(beta: float = 1.0) -> Callable[[], Column]:
    b = beta * beta

    def objective() -> Column:
        return F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp"))

    return objective


def payoff(tp: float = 1, fp: float = -1, tn: float = 1, fn: float = -1) -> Callable[[], Column]:
    return lambda: tp * F.col("tp") + fp * F.col("fp") + tn * F.col("tn") + fn * F.col("fn")


def best_threshold(points: DataFrame, objective: Callable[[], Column], maximize: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Point of the best objective; among equals the highest threshold (the first in ROC order)."""
    v = objective()
    rank = F.struct(v if maximize else -v, F.col("threshold"))
    cols = [c for c in points.columns if c not in by]
    best = F.max_by(F.struct(*cols, v.alias("objective")), F.when(v.isNotNull(), rank))
    return points.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def value_curve(df: DataFrame, y: str, p: str, tp: float = 1, fp: float = -1, tn: float = 1, fn: float = -1) -> DataFrame:
    """Value at each threshold, with the two ends: nobody (1.1 of the maximum) and everybody (.9 of the minimum)."""
    value = payoff(tp, fp, tn, fn)
    curve = roc_points(df, y, p).select("threshold", value().alias("value"))
    ends = df.agg(
        F.max(p).alias("hi"), F.min(p).alias("lo"), F.sum((F.col(y) == 1).cast("double")).alias("a"), F.sum((F.col(y) != 1).cast("double")).alias("b")
    )
    cells = F.array(
        F.struct((F.col("hi") * 1.1).alias("threshold"), (tn * F.col("b") + fn * F.col("a")).alias("value")),
        F.struct((F.col("lo") * 0.9).alias("threshold"), (tp * F.col("a") + fp * F.col("b")).alias("value")),
    )
    return curve.unionByName(ends.select(F.inline(cells)))


def confusion_at(df: DataFrame, y: str, p: str, threshold: float, strict_reference: bool = False) -> DataFrame:
    """tp, fp, tn, fn at a threshold; the strict form counts a score equal to it as an error on both sides."""
    s, pos = F.col(p), F.col(y) == 1
    up = s > threshold if strict_reference else s >= threshold
    down = s < threshold
    return df.agg(
        F.count_if(pos & up).alias("tp"), F.count_if(~pos & ~down).alias("fp"), F.count_if(~pos & down).alias("tn"), F.count_if(pos & ~up).alias("fn")
    )


def best_f1_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    return best_threshold(roc_points(df, y, p), f_beta(1.0)).select("threshold", "tp", "fp", "tn", "fn", F.col("objective").alias("f1"))


def campaign_curve(df: DataFrame, score: str, margin: float, cost: float) -> DataFrame:
    """Customers in falling order of expected profit: size and cumulative profit at each distinct profit."""
    x = df.withColumn("profit", F.col(score) * margin - cost)
    t = prefix_sum(x, "profit", {"p": F.col("profit"), "n": F.lit(1)}, descending=True)
    return t.select("profit", F.col("cum_n").alias("size"), F.col("cum_p").alias("cum_profit"))


def campaign_optimum(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max_by(F.struct("size", "cum_profit"), F.struct("cum_profit", -F.col("size"))).alias("b")).select("b.*")


def quota_assign(
    df: DataFrame, row_id: str, choices: Sequence[str], minimum: Mapping[str, int], maximum: Mapping[str, int], total: int
) -> DataFrame:
    """One choice for ``total`` rows under quotas: ``row_id, choice, prob``.

    Minimums come first, the choice of lowest mean taking its best rows first.  Then rows in falling
    order of their best open choice are accepted up to the first that would break a maximum, that
    choice is closed, and the rest starts over; so there are at most as many rounds as choices.
    Places in the order come from sliced running counts, never from one sorted task.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in choices]).first().asDict()
    left = materialize(df.select(row_id, *choices))
    taken, room, open_total = None, dict(maximum), total

    def take(rows):
        nonlocal taken, left
        rows = materialize(rows)
        taken = rows if taken is None else taken.unionByName(rows)
        left = materialize(left.join(rows, row_id, "left_anti"))
        return {r["choice"]: r["n"] for r in rows.groupBy("choice").agg(F.count(F.lit(1)).alias("n")).collect()}

    for c in sorted(choices, key=lambda c: (means[c], c)):
        if minimum.get(c, 0):
            p = row_positions(left, [c, row_id], name="_pos", descending=True).filter(F.col("_pos") <= minimum[c])
            got = take(p.select(row_id, F.lit(c).alias("choice"), F.col(c).alias("prob"))).get(c, 0)
            room[c], open_total = room[c] - got, open_total - got
    live = [c for c in choices if room[c] > 0]
    while live and open_total > 0:
        best = F.greatest(*live) if len(live) > 1 else F.col(live[0])
        pick = reduce(lambda acc, c: F.when(F.col(c) == F.col("prob"), F.lit(c)).otherwise(acc), reversed(live), F.lit(None))
        b = left.withColumn("prob", best).withColumn("choice", pick).select(row_id, "choice", "prob")
        b = row_positions(b, ["prob", row_id], ["choice"], "_in_choice", descending=True)
        b = materialize(row_positions(b, ["prob", row_id], name="_pos", descending=True))
        caps = reduce(lambda acc, c: F.when(F.col("choice") == c, F.lit(room[c])).otherwise(acc), live, F.lit(0))
        stop = b.filter(F.col("_in_choice") > caps).agg(F.min("_pos").alias("s")).first()["s"]
        upto = min(open_total, (stop - 1) if stop else open_total)
        got = take(b.filter(F.col("_pos") <= upto).select(row_id, "choice", "prob"))
        for c, n in got.items():
            room[c] -= n
        done = sum(got.values())
        open_total -= done
        if not stop:
            break
        live = [c for c in live if room[c] > 0]
    return taken


def tier_assign(df: DataFrame, need: Column, tiers: Sequence[float], old_tier: float, duration: str, actual: str, rate: float) -> DataFrame:
    """Container of the interval that holds the buffered need (clamped at both ends), old and new cost;
    where the actual need exceeds the buffered one both are paid."""
    cuts = sorted(tiers)
    x = df.withColumn("need", need)
    size = reduce(lambda acc, i: F.when(F.col("need") >= cuts[i - 1], F.lit(float(cuts[i]))).otherwise(acc), range(1, len(cuts)), F.lit(float(cuts[0])))
    hours = F.col(duration) * rate
    x = x.withColumn("tier", size).withColumn("old_cost", old_tier * hours)
    new = F.col("tier") * hours
    return x.withColumn("new_cost", F.when(F.col("need") < F.col(actual), new + F.col("old_cost")).otherwise(new))


def tier_savings(costed: DataFrame) -> DataFrame:
    s = F.sum("old_cost") - F.sum("new_cost")
    return costed.agg(s.alias("savings"), F.try_divide(s, F.sum("old_cost")).alias("share"), F.count_if(F.col("new_cost") > F.col("old_cost")).alias("dearer"))
