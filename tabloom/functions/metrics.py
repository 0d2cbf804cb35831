"""Evaluation metrics as single aggregate columns, for use under any ``groupBy`` or ``rollup``.

Arguments are columns ``y`` (actual), ``p`` (prediction) and an optional weight ``w``.  A weighted
metric is sum(w * loss) / sum(w), and 0 if the weights sum to 0.  Undefined values are NULL.
Formulas are the published ones.  Metrics that need a global order are in ``operators.ranking``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

EPS = 1e-15


def wavg(loss: Column, w: Column | None = None) -> Column:
    if w is None:
        return F.avg(loss)
    known = F.when(loss.isNotNull(), w)
    total = F.sum(known)
    return F.when(total == 0, 0.0).otherwise(F.try_divide(F.sum(loss * known), total))


def _floor(c: Column, lo: float) -> Column:
    return F.when(c < lo, F.lit(lo)).otherwise(c.cast("double"))


def _clip(c: Column) -> Column:
    return F.when(c < EPS, F.lit(EPS)).when(c > 1 - EPS, F.lit(1 - EPS)).otherwise(c.cast("double"))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def logloss(y, p, w=None):
    q = _clip(p)
    return wavg(-(_xlogy(y, q) + _xlogy(1 - y, 1 - q)), w)


def multiclass_logloss(true_probability: Column, w=None):
    """``true_probability`` is the predicted probability of the actual class."""
    return wavg(-F.ln(_clip(true_probability)), w)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logloss_logits(y, p, w=None):
    return logloss(sigmoid(y), sigmoid(p), w)


def accuracy(y, p, w=None):
    return wavg((F.rint(p) == y).cast("double"), w)


def balanced_accuracy(y: Column, p: Column, classes: Sequence = (0, 1), w=None):
    """Mean recall over the classes that occur; ``p`` is rounded to the nearest class."""
    recalls = [wavg(F.when(y == c, (F.rint(p) == c).cast("double")), w) for c in classes]
    present = [F.count_if(y == c) > 0 for c in classes]
    total = reduce(lambda a, b: a + b, [F.when(k, r).otherwise(0.0) for k, r in zip(present, recalls)])
    return F.try_divide(total, reduce(lambda a, b: a + b, [k.cast("int") for k in present]))


def mean_separation(y, p, w=None):
    return wavg(F.when(y == 1, p), w) - wavg(F.when(y == 0, p), w)


def separation_spread(y, p):
    """Smallest score of the positives minus the largest of the negatives."""
    return F.min(F.when(y == 1, p)) - F.max(F.when(y == 0, p))


def r_squared(y, p, w=None):
    w = F.lit(1.0) if w is None else w
    mean_ss = F.sum(w * y * y) - F.try_divide(F.sum(w * y) * F.sum(w * y), F.sum(w))
    return F.when(mean_ss > 0, 1 - F.sum(w * (y - p) * (y - p)) / mean_ss).otherwise(0.0)


def rmse(y, p, w=None):
    return F.sqrt(wavg((y - p) * (y - p), w))


def mae(y, p, w=None):
    return wavg(F.abs(y - p), w)


def rmsle(y, p, w=None):
    d = F.log1p(_floor(y, 0.0)) - F.log1p(_floor(p, 0.0))
    return F.sqrt(wavg(d * d, w))


def poisson_deviance(y, p, w=None):
    a, q = _floor(y, 0.0), _floor(p, 1e-8)
    return wavg(2 * F.when(a == 0, q).otherwise(_xlogy(a, a / q) - (a - q)), w)


def gamma_deviance(y, p, w=None, floor: float = 0.01):
    a, q = _floor(y, floor), _floor(p, floor)
    return wavg(2 * (-F.ln(a / q) + (a - q) / q), w)


def tweedie_deviance(y, p, w=None, power: float = 1.5, floor: float = 1e-8):
    if not 1 <= power <= 2:
        raise ValueError("power must lie in [1, 2]")
    if power == 1:
        return poisson_deviance(y, p, w)
    if power == 2:
        return gamma_deviance(y, p, w)
    a, q = _floor(y, 0.0), _floor(p, floor)
    d = F.pow(a, 2 - power) / ((1 - power) * (2 - power)) - a * F.pow(q, 1 - power) / (1 - power) + F.pow(q, 2 - power) / (2 - power)
    return wavg(2 * d, w)


def _fve(dev: Column, null_dev: Column) -> Column:
    return F.when(null_dev > 0, 1 - dev / null_dev).otherwise(0.0)


def fve_binomial(y, p, w=None):
    """The deviance of the mean has a closed form, so one aggregation is enough (also below)."""
    m = _clip(wavg(y, w))
    return _fve(logloss(y, p, w), -(m * F.ln(m) + (1 - m) * F.ln(1 - m)))


def fve_poisson(y, p, w=None):
    a = _floor(y, 0.0)
    m = wavg(a, w)
    return _fve(poisson_deviance(y, p, w), 2 * (wavg(_xlogy(a, F.when(a > 0, a)), w) - m * F.ln(m)))


def fve_tweedie(y, p, w=None, power: float = 1.5):
    a = _floor(y, 0.0)
    m = wavg(a, w)
    null = 2 * (
        wavg(F.pow(a, 2 - power), w) / ((1 - power) * (2 - power)) - F.pow(m, 2 - power) / (1 - power) + F.pow(m, 2 - power) / (2 - power)
    )
    return _fve(tweedie_deviance(y, p, w, power), null)


def fve_gamma(y, p, w=None):
    a = _floor(y, 0.01)
    return _fve(gamma_deviance(y, p, w), 2 * (F.ln(wavg(a, w)) - wavg(F.ln(a), w)))


def mape(y, p, w=None):
    a, q = _floor(y, 1e-4), _floor(p, 1e-4)
    return 100 * wavg(F.abs(a - q) / a, w)


def mape_signed(y, p, zero_infinite: bool = False):
    """|a - p| / a with the sign of a kept; undefined terms are dropped, or count as 0."""
    term = F.try_divide(F.abs(y - p), y)
    return F.avg(F.coalesce(term, F.lit(0.0)) if zero_infinite else term)


def smape(y, p):
    return F.avg(F.try_divide(F.abs(p - y), (F.abs(y) + F.abs(p)) / 2))


# Metric -> family of its normalised score.
FAMILIES = {
    "AUC": "half_to_one",
    "Accuracy": "zero_to_one",
    "Balanced Accuracy": "zero_to_one",
    "Kolmogorov-Smirnov": "zero_to_one",
    "Gini Norm": "zero_to_one",
    "R Squared": "zero_to_one",
    "FVE Binomial": "zero_to_one",
    "FVE Poisson": "zero_to_one",
    "FVE Gamma": "zero_to_one",
    "FVE Tweedie": "zero_to_one",
    "NDCG": "zero_to_one",
    "Rate@Top10%": "up_from_null",
    "Rate@Top5%": "up_from_null",
    "MAPE": "down_from_null",
    "Gini": "open_up",
    "AMS@15%tsh": "open_up",
    "AMS@opt_tsh": "open_up",
    "LogLoss": "open_down",
    "MAD": "open_down",
    "MAE": "open_down",
    "RMSE": "open_down",
    "RMSLE": "open_down",
    "Poisson Deviance": "open_down",
    "Tweedie Deviance": "open_down",
    "Gamma Deviance": "open_down",
}


def normalized_score(family: Column, score: Column, null_score: Column) -> Column:
    """Score on a scale where 0 is no information and 1 is perfect."""

    def logistic(ratio):
        return 2 / (1 + F.exp(-0.1 * (ratio - 1))) - 1

    return (
        F.when(family == "half_to_one", 2 * (score - 0.5))
        .when(family == "zero_to_one", score)
        .when(family == "down_from_null", logistic(null_score / F.greatest(score, F.lit(0.001))))
        .when(family == "up_from_null", logistic(score / F.greatest(null_score, F.lit(0.001))))
        .when(family == "open_up", 1 - F.try_divide(null_score, score))
        .when(family == "open_down", 1 - F.try_divide(score, null_score))
    )


SIMPLE = {
    "LogLoss": logloss, "Accuracy": accuracy, "Balanced Accuracy": lambda y, p, w=None: balanced_accuracy(y, p, (0, 1), w),
    "FVE Binomial": fve_binomial, "R Squared": r_squared, "RMSE": rmse, "MAE": mae, "RMSLE": rmsle,
    "Poisson Deviance": poisson_deviance, "Tweedie Deviance": tweedie_deviance, "Gamma Deviance": gamma_deviance,
    "FVE Poisson": fve_poisson, "FVE Tweedie": fve_tweedie, "FVE Gamma": fve_gamma, "MAPE": mape,
}
