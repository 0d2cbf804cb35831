"""Statistical tests on tables.

Regressions take two passes: one aggregation collects the (k+1) x (k+1) product sums, the small
solve runs with numpy on the driver, and residual statistics come from a second aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tabloom.operators.order import null_safe_join, prefix_sum, quantiles
from tabloom.operators.sampling import bootstrap


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of all column pairs (with a leading constant 1), one row per ``by``."""
    c = [F.lit(1.0), *[F.col(x).cast("double") for x in cols]]
    cells = [F.sum(c[i] * c[j]).alias(f"g_{i}_{j}") for i in range(len(c)) for j in range(i, len(c))]
    return df.dropna(subset=list(cols)).groupBy(*by).agg(*cells)


def gram_matrix(row, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    return g


@dataclass(frozen=True)
class Ols:
    names: tuple[str, ...]
    coef: tuple[float, ...]  # intercept first
    n: float
    rss: float
    tss: float
    xtx_inv: np.ndarray

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else 0.0

    def fitted(self) -> Column:
        out = F.lit(float(self.coef[0]))
        for c, b in zip(self.names, self.coef[1:]):
            out = out + F.lit(float(b)) * F.col(c)
        return out


def _solve(g: np.ndarray, x: Sequence[str]) -> Ols:
    """Solve on centred and scaled sums, which keeps the small system well conditioned."""
    k = len(x)
    n = g[0, 0]
    mean = g[0, 1:] / n
    s = g[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
    r = s / np.outer(scale, scale)
    b = np.linalg.lstsq(r[:k, :k], r[:k, k], rcond=None)[0] * scale[k] / scale[:k] if k else np.zeros(0)
    tss = s[k, k]
    rss = max(tss - b @ s[:k, k], 0.0)
    return Ols(tuple(x), (mean[k] - b @ mean[:k], *b), n, rss, tss, np.linalg.pinv(g[: k + 1, : k + 1]))


def ols(df: DataFrame, y: str, x: Sequence[str]) -> Ols:
    """Least squares of y on x with a constant."""
    return _solve(gram_matrix(gram(df, [*x, y]).first(), len(x) + 2), x)


def ols_table(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    m = ols(df, y, x)
    rows = list(zip(["const", *x], [float(v) for v in m.coef]))
    return df.sparkSession.createDataFrame(rows, "term string, coef double").withColumns({"n": F.lit(int(m.n)), "rss": F.lit(float(m.rss)), "r2": F.lit(float(m.r2))})


def vif(df: DataFrame, x: Sequence[str]) -> DataFrame:
    """Variance inflation and drop-one R2 from the inverse correlation matrix."""
    k = len(x)
    g = gram_matrix(gram(df, x).first(), k + 1)
    mean = g[0, 1:] / g[0, 0]
    s = g[1:, 1:] - g[0, 0] * np.outer(mean, mean)
    d = np.sqrt(np.diag(s))
    v = np.diag(np.linalg.pinv(s / np.outer(d, d)))
    return df.sparkSession.createDataFrame([(c, float(a), float(1 - 1 / a)) for c, a in zip(x, v)], "feature string, vif double, r2 double")


def condition_number(df: DataFrame, x: Sequence[str]) -> DataFrame:
    """sqrt of the eigenvalue ratio of X'X with unit-length columns; the constant stays as it is."""
    g = gram_matrix(gram(df, x).first(), len(x) + 1)
    d = np.concatenate([[1.0], np.sqrt(np.diag(g)[1:])])
    e = np.linalg.eigvalsh(g / np.outer(d, d))
    return df.sparkSession.createDataFrame([(float(math.sqrt(e[-1] / max(e[0], 1e-300))),)], "condition_number double")


def chow_test(df: DataFrame, y: str, x: Sequence[str], side: Column, k: int = 2) -> DataFrame:
    """Break test between the two sides of a condition; both fits come from one grouped aggregation."""
    rows = {r["_side"]: gram_matrix(r, len(x) + 2) for r in gram(df.withColumn("_side", side), [*x, y], ["_side"]).collect() if r["_side"] is not None}
    if len(rows) != 2:
        raise ValueError("both sides need rows")
    a, b = _solve(rows[True], x), _solve(rows[False], x)
    both = _solve(rows[True] + rows[False], x)
    f = ((both.rss - a.rss - b.rss) / k) / ((a.rss + b.rss) / (a.n + b.n - 2 * k))
    return df.sparkSession.createDataFrame([(float(f), k, int(a.n + b.n - 2 * k))], "f double, df1 int, df2 int")


def reset_test(df: DataFrame, y: str, x: Sequence[str], powers: int = 3) -> DataFrame:
    """Specification test: F for adding powers 2..``powers`` of the (scaled) fitted values."""
    m = ols(df, y, x)
    sd = math.sqrt(m.tss / m.n) or 1.0
    centre = df.agg(F.avg(y)).first()[0]
    z = (m.fitted() - F.lit(float(centre))) / F.lit(sd)
    extra = [f"_f{p}" for p in range(2, powers + 1)]
    wide = df.withColumns({f"_f{p}": F.pow(z, F.lit(float(p))) for p in range(2, powers + 1)})
    big = ols(wide, y, [*x, *extra])
    q, free = len(extra), m.n - len(x) - 1 - len(extra)
    f = ((m.rss - big.rss) / q) / (big.rss / free)
    return df.sparkSession.createDataFrame([(float(f), q, int(free))], "f double, df1 int, df2 int")


def heteroscedasticity(df: DataFrame, y: str, x: Sequence[str], white: bool = False) -> DataFrame:
    """LM = n R2 of the squared residuals on X (Breusch-Pagan) or on X, squares and products (White)."""
    m = ols(df, y, x)
    d = df.withColumn("_r2", (F.col(y) - m.fitted()) ** 2 / F.lit(float(m.rss / m.n)))
    terms = list(x)
    if white:
        extra = {f"_x{i}_{j}": F.col(x[i]) * F.col(x[j]) for i in range(len(x)) for j in range(i, len(x))}
        d, terms = d.withColumns(extra), [*x, *extra]
    aux = ols(d, "_r2", terms)
    return df.sparkSession.createDataFrame([(float(aux.n * aux.r2), len(terms))], "lm double, dof int")


@F.pandas_udf(DoubleType())
def _log_cdf(z: pd.Series) -> pd.Series:
    """Log of the normal distribution function."""
    return pd.Series([math.log(max(0.5 * math.erfc(-v / math.sqrt(2)), 1e-300)) for v in z])


def anderson_darling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2 statistic of normality per column, from running counts of distinct standardised values."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], list(cols), "column", "_v").filter("_v is not null")
    stats = long.groupBy("column").agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"), F.count(F.lit(1)).alias("_n"))
    t = prefix_sum(long, "_v", {"k": F.lit(1)}, ["column"]).join(stats, "column")
    z = (F.col("_v") - F.col("_m")) / F.col("_s")
    b, a, n = F.col("cum_k").cast("double"), (F.col("cum_k") - F.col("k")).cast("double"), F.col("_n")
    sq = b * b - a * a
    term = sq * _log_cdf(z) + ((b - a) * 2 * n - sq) * _log_cdf(-z)
    return t.groupBy("column").agg((-F.max("_n") - F.sum(term) / F.max("_n")).alias("a2"), F.max("_n").alias("n"))


def ks_two_sample(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Largest gap between two empirical distribution functions."""
    u = a.select(F.col(col).alias("_v"), F.lit(1).alias("_a")).unionByName(b.select(F.col(col).alias("_v"), F.lit(0).alias("_a"))).filter("_v is not null")
    t = prefix_sum(u, "_v", {"x": F.col("_a"), "y": 1 - F.col("_a")})
    tot = u.agg(F.sum("_a").alias("_x"), F.sum(1 - F.col("_a")).alias("_y"))
    gap = F.abs(F.col("cum_x") / F.col("_x") - F.col("cum_y") / F.col("_y"))
    return t.crossJoin(F.broadcast(tot)).agg(F.max(gap).alias("ks"))


def woe_iv(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """Weight of evidence per (feature, level) and information value per feature, all in one long pass.

    Numeric features get ``bins`` percentile bins, closed on the left.  An empty class clamps to +-20.
    """
    parts = []
    if numeric:
        long = df.select(F.col(y).alias("_y"), *[F.col(c).cast("double") for c in numeric]).unpivot(["_y"], list(numeric), "feature", "_v")
        e = quantiles(long, "_v", [i / bins for i in range(1, bins)], ["feature"])
        b = long.join(F.broadcast(e), "feature")  # one row per listed feature
        level = sum([(F.col("_v") >= F.col(f"q{i}")).cast("int") for i in range(bins - 1)], F.lit(1))
        parts.append(b.select("feature", level.cast("string").alias("level"), "_y"))
    if categorical:
        c = df.select(F.col(y).alias("_y"), *[F.col(c).cast("string") for c in categorical])
        parts.append(c.unpivot(["_y"], list(categorical), "feature", "level").select("feature", "level", "_y"))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    g = long.groupBy("feature", "level").agg(F.sum("_y").alias("events"), F.sum(1 - F.col("_y")).alias("non_events"))
    tot = g.groupBy("feature").agg(F.sum("events").alias("_e"), F.sum("non_events").alias("_n"))
    j = g.join(tot, "feature")
    pe, pn = F.col("events") / F.col("_e"), F.col("non_events") / F.col("_n")
    woe = F.when(pe == 0, -20.0).when(pn == 0, 20.0).otherwise(F.ln(pe / pn))
    j = j.withColumn("woe", woe).withColumn("_part", (pe - pn) * F.col("woe"))
    iv = j.groupBy("feature").agg(F.sum("_part").alias("iv"))
    return j.join(iv, "feature").select("feature", "level", "events", "non_events", "woe", "iv")


def categorical_iv(df: DataFrame, feature: str, y: str) -> DataFrame:
    """IV with the opposite sign convention, ln(good share / bad share); infinite terms count as 0."""
    g = df.groupBy(feature).agg(F.sum(1 - F.col(y)).alias("good"), F.sum(y).alias("bad"))
    tot = g.agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    a, b = F.col("good") / F.col("_g"), F.col("bad") / F.col("_b")
    woe = F.when((a > 0) & (b > 0), F.ln(a / b)).otherwise(0.0)
    return g.crossJoin(F.broadcast(tot)).select(feature, "good", "bad", woe.alias("woe"), ((a - b) * woe).alias("iv"))


def ngram_lift(df: DataFrame, term: str, cluster: str, doc: str) -> DataFrame:
    """Per (term, cluster): documents with the term inside and outside, smoothed lift, chi-square."""
    has = df.select(term, cluster, doc).distinct()
    inside = has.groupBy(term, cluster).agg(F.count(F.lit(1)).alias("a"))
    everywhere = inside.groupBy(term).agg(F.sum("a").alias("_t"))
    size = df.select(cluster, doc).distinct().groupBy(cluster).agg(F.count(F.lit(1)).alias("na"))
    total = size.agg(F.sum("na").alias("_n"))
    j = inside.join(everywhere, term).join(size, cluster).crossJoin(F.broadcast(total))
    a, na = F.col("a"), F.col("na")
    b, nb, n = F.col("_t") - a, F.col("_n") - na, F.col("_n")
    lift = F.try_divide(a / na, (b + 10) / nb)
    t = F.col("_t")
    chi = F.try_divide(n * F.pow(a * (nb - b) - b * (na - a), F.lit(2.0)), na.cast("double") * nb * t * (n - t))
    return j.select(term, cluster, "a", "na", b.alias("b"), nb.alias("nb"), lift.alias("lift"), chi.alias("chi2"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    def pairs(c):
        return F.sum(c * (c - 1) / 2)

    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ij = cells.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("n"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("i"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("j"))
    t = ij.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(rb))
    want = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return t.select(F.try_divide(F.col("ij") - want, (F.col("i") + F.col("j")) / 2 - want).alias("ari"))


def bootstrap_ci(df: DataFrame, key: Sequence[str], value: str, replicates: int = 200, level: float = 0.95, seed: int = 1, draw: Column | None = None) -> DataFrame:
    """Percentile interval of the mean from Poisson bootstrap weights; replicates are aggregated map-side.  ``draw`` as in ``sampling.bootstrap``."""
    r = bootstrap(df.select(*key, value), key, replicates, seed, draw)
    m = r.groupBy("replicate").agg((F.sum(F.col(value) * F.col("copies")) / F.sum("copies")).alias("m"))
    tail = (1 - level) / 2
    q = quantiles(m, "m", [tail, 1 - tail], slices=4).toDF("lower", "upper")
    return q.crossJoin(F.broadcast(m.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))))


def influence(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """Leverage, PRESS and studentised residuals, DFFITS and its flag; row expressions on the small inverse."""
    m = ols(df, y, x)
    inv, k = m.xtx_inv, len(x) + 1
    v = [F.lit(1.0), *[F.col(c) for c in x]]
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + F.lit(float(inv[i, j])) * v[i] * v[j]
    s2 = m.rss / (m.n - k)
    d = df.withColumns({"leverage": h, "residual": F.col(y) - m.fitted()})
    e, one_h = F.col("residual"), 1 - F.col("leverage")
    ext = (m.rss - e * e / one_h) / (m.n - k - 1)
    d = d.withColumns({"press": e / one_h, "studentised": e / F.sqrt(F.lit(s2) * one_h), "_t": e / F.sqrt(ext * one_h)})
    d = d.withColumn("dffits", F.col("_t") * F.sqrt(F.col("leverage") / one_h)).drop("_t")
    return d.withColumn("influential", F.abs("dffits") > 2 * math.sqrt(k / m.n))


def rank_sum(df: DataFrame, value: str, group: Column, alternative: str | None = None) -> DataFrame:
    """Wilcoxon rank-sum of the rows where ``group`` holds against the others: U, z with tie correction.

    With an ``alternative`` (greater, less or two-sided) also ``p`` of the normal approximation.
    """
    x = df.filter(F.col(value).isNotNull() & group.isNotNull()).select(value, group.cast("int").alias("_g"))
    t = prefix_sum(x, value, {"n": F.lit(1), "g": F.col("_g")})
    mid = F.col("cum_n") - (F.col("n") - 1) / 2
    n = F.col("n").cast("double")
    s = t.agg(F.sum(mid * F.col("g")).alias("w"), F.sum("g").cast("double").alias("a"), F.sum("n").cast("double").alias("n"), F.sum(n * n * n - n).alias("ties"))
    a, big = F.col("a"), F.col("n")
    b = big - a
    u = F.col("w") - a * (a + 1) / 2
    var = a * b / 12 * (big + 1 - F.col("ties") / (big * (big - 1)))
    found = s.select(u.alias("u"), ((u - a * b / 2) / F.sqrt(var)).alias("z"))
    if alternative is None:
        return found
    turn = {"greater": lambda z: z, "less": lambda z: -z, "two-sided": lambda z: z.abs()}[alternative]
    sides = 2 if alternative == "two-sided" else 1

    def upper(frames):
        for f in frames:  # one row
            yield f.assign(p=[sides * 0.5 * math.erfc(z / math.sqrt(2)) for z in turn(f["z"])])

    return found.mapInPandas(upper, "u double, z double, p double")
