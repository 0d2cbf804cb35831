"""Group aggregates, pivots and table-level reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.operators.order import null_safe_join, quantiles, row_positions
from tabloom.session import small_side
from tabloom.spec import numeric_columns


def sum_rest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Duplicates collapsed by summing ``value``; rows with a NULL key are dropped as pandas does."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum(value).alias(value))


def value_counts(df: DataFrame, cols: Sequence[str], normalize: bool = False) -> DataFrame:
    """Frequencies of several columns in one pass: ``column, value, n`` (and ``share``)."""
    long = df.select(*[F.col(c).cast("string") for c in cols]).unpivot([], list(cols), "column", "value")
    out = long.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        tot = out.groupBy("column").agg(F.sum("n").alias("_t"))
        out = out.join(tot, "column").withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    return out


def mode_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per group, the smallest among equals; counts first, so no group is buffered."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` tuple per group, by ``max_by`` (partial aggregation, no sort)."""
    pick = F.max_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*by).agg(pick.alias("_r")).select(*by, "_r.*")


def collect_sorted(df: DataFrame, by: Sequence[str], item: str, name: str = "items") -> DataFrame:
    """Sorted distinct items per group as an array, for groups whose items are known to be few."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(item)).alias(name))


def positions_by(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """The long form of the above for groups of any size: ``by, pos, item``."""
    return row_positions(df.select(*by, item).distinct(), [item], by)


def pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, aggs: Mapping[str, Column], fill=None) -> DataFrame:
    """Long to wide with an explicit value list, so that no extra pass looks for the values."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(*[c.alias(n) for n, c in aggs.items()])
    return out if fill is None else out.fillna(fill)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value", drop_null: bool = True) -> DataFrame:
    out = df.unpivot(list(ids), list(values), variable, value)
    return out.filter(F.col(value).isNotNull()) if drop_null else out


def with_grand_total(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], suffix: str = "_total") -> DataFrame:
    """Group aggregates with the grand total of the same aggregates beside them."""
    g = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    total = df.agg(*[c.alias(f"{n}{suffix}") for n, c in aggs.items()])
    return g.crossJoin(F.broadcast(total))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(F.when(value.isNotNull(), value * weight)), F.sum(F.when(value.isNotNull(), weight)))


def weighted_std(value: Column, weight: Column) -> Column:
    """Divisor sum(w) - sum(w^2)/sum(w)."""
    w, v = F.when(value.isNotNull(), weight), value
    sw = F.sum(w)
    ss = F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / sw
    return F.sqrt(F.greatest(F.try_divide(ss, sw - F.sum(w * w) / sw), F.lit(0.0)))


def describe_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], positive_only: bool = False) -> DataFrame:
    """One row per (keys, column): n, sum, min, quartiles, IQR, mean, max, sd."""
    long = df.select(*keys, *[F.col(c).cast("double") for c in cols]).unpivot(list(keys), list(cols), "column", "_v")
    long = long.filter("_v > 0" if positive_only else "_v is not null")
    g = [*keys, "column"]
    base = long.groupBy(*g).agg(
        F.count("_v").alias("n"), F.sum("_v").alias("sum"), F.min("_v").alias("min"), F.avg("_v").alias("mean"),
        F.max("_v").alias("max"), F.stddev_samp("_v").alias("sd"),
    )
    q = quantiles(long, "_v", [0.25, 0.5, 0.75], g)
    out = null_safe_join(base, q, g).withColumnsRenamed({"q0": "q25", "q1": "median", "q2": "q75"})
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct counts of all columns in one long-form pass: ``column, n_distinct, n``."""
    cols = list(cols or df.columns)
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    t = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return t.crossJoin(F.broadcast(rows))


def drop_uninformative(df: DataFrame, share: float = 0.99) -> DataFrame:
    """Without constant columns and without columns whose distinct count is >= ``share`` of the rows."""
    keep = {r["column"] for r in distinct_counts(df).filter((F.col("n_distinct") > 1) & (F.col("n_distinct") < share * F.col("n"))).collect()}
    return df.select(*[c for c in df.columns if c in keep])


def group_regression(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of y on x per group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted) with row and column error shares; the totals are tiny joins."""
    c = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    rows = c.groupBy(actual).agg(F.sum("n").alias("row_n"))
    cols = c.groupBy(predicted).agg(F.sum("n").alias("col_n"))
    out = c.join(rows, actual).join(cols, predicted)
    return out.withColumns({"row_share": F.col("n") / F.col("row_n"), "col_share": F.col("n") / F.col("col_n")})


def share_in_group(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    tot = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    return null_safe_join(df, tot, by).withColumn(name, F.try_divide(F.col(value), F.col("_t"))).drop("_t")


def cluster_summary(df: DataFrame, cluster: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Per cluster: size, means, modes and a label naming the columns whose cluster mean lies more
    than one standard deviation from the mean of the cluster means."""
    base = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in numeric])
    long = base.unpivot([cluster], [f"mean_{c}" for c in numeric], "_c", "_m")
    ref = long.groupBy("_c").agg(F.avg("_m").alias("_a"), F.stddev_samp("_m").alias("_s"))
    away = F.col("_m") - F.col("_a")
    word = F.when(away > F.col("_s"), "high ").when(away < -F.col("_s"), "low ")
    flags = long.join(F.broadcast(ref), "_c").withColumn("_f", F.concat(word, F.substring("_c", 6, 200)))
    labels = flags.groupBy(cluster).agg(F.array_join(F.sort_array(F.collect_list("_f")), ", ").alias("label"))
    out = base.join(labels, cluster)
    for c in categorical:
        out = out.join(mode_by(df, [cluster], c).select(cluster, F.col("mode").alias(f"mode_{c}")), cluster)
    return out


def split_to_tables(df: DataFrame, id_col: str, code_cols: Sequence[str], flag_cols: Sequence[str], no_flag="No") -> dict[str, DataFrame]:
    """Wide table -> base, long codes, code lookup and long flags (those that differ from ``no_flag``)."""
    codes = melt(df, [id_col], code_cols, "slot", "code")
    flags = melt(df, [id_col], flag_cols, "name", "state").filter(F.col("state") != no_flag)
    return {
        "base": df.drop(*code_cols, *flag_cols),
        "codes": codes,
        "lookup": codes.select("code").distinct(),
        "flags": flags,
    }


# ---------------------------------------------------------------- pairwise correlation

PAIR = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("i", "j")]
    + [T.StructField(c, T.DoubleType()) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
)


def _block_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over dates for every (i, j) of two blocks of series, as matrix products."""
    import numpy as np

    bi, bj = pdf["bi"].iloc[0], pdf["bj"].iloc[0]

    def matrix(block):
        part = pdf[pdf["block"] == block]
        return part.pivot(index="date", columns="idx", values="v")

    x = matrix(bi)
    y = x if bi == bj else matrix(bj)
    dates = x.index.intersection(y.index)
    x, y = x.loc[dates], y.loc[dates]
    a, b = x.to_numpy(), y.to_numpy()
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    fa, fb = ma.astype(float), mb.astype(float)
    mats = [fa.T @ fb, a.T @ fb, fa.T @ b, (a * a).T @ fb, fa.T @ (b * b), a.T @ b]
    ii, jj = np.meshgrid(x.columns.to_numpy(), y.columns.to_numpy(), indexing="ij")
    keep = (ii < jj) & (mats[0] > 0)
    out = {"i": ii[keep].astype("int64"), "j": jj[keep].astype("int64")}
    out |= {c: m[keep] for c, m in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), mats)}
    return pd.DataFrame(out)


def pairwise_sums(
    df: DataFrame, series: str, date: str, value: str, block: int = 512, date_slices: int | None = None, centre: bool = False, anchors: DataFrame | None = None
) -> DataFrame:
    """``series_1 < series_2`` with n, sx, sy, sxx, syy, sxy over shared dates, for every pair of series.

    With ``anchors`` (a table of some of the series) only pairs that have one of them, which comes first then; their blocks alone meet the others.

    Series are numbered and cut into blocks; a task gets two blocks and one slice of the dates and
    adds up matrix products, so no date ever emits its pairs of rows.  A slice has about 1000 dates.
    """
    if date_slices is None:
        date_slices = max(8, df.select(date).distinct().count() // 1000)
    means = df.groupBy(series).agg((F.avg(value) if centre else F.lit(0.0)).alias("_m"))
    if anchors is not None:
        known = small_side(anchors.select(series).distinct().withColumn("_late", F.lit(0)))
        means = means.join(known, series, "left").fillna({"_late": 1})
    ids = row_positions(means, [series] if anchors is None else ["_late", series], name="idx").withColumn("idx", F.col("idx") - 1).drop("_late")
    n_blocks = -(-ids.count() // block)
    n_first = anchors.select(series).distinct().count() if anchors is not None else None
    rows = (
        df.filter(F.col(value).isNotNull())
        .join(ids, series)
        .select(
            F.col(date).cast("string").alias("date"),
            "idx",
            F.floor(F.col("idx") / block).alias("block"),
            (F.col(value) - F.col("_m")).alias("v"),
            F.pmod(F.xxhash64(date), F.lit(date_slices)).alias("ds"),
        )
    )
    placed = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"), "ds", "date", "idx", "block", "v"
    )
    if n_first is not None:
        placed = placed.filter(F.col("bi") * block < n_first)
    sums = placed.groupBy("bi", "bj", "ds").applyInPandas(_block_products, PAIR)
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    if n_first is not None:
        total = total.filter(F.col("i") < n_first)  # i < j, and anchors have the first numbers
    a = ids.select(F.col("idx").alias("i"), F.col(series).alias("series_1"))
    b = ids.select(F.col("idx").alias("j"), F.col(series).alias("series_2"))
    return total.join(a, "i").join(b, "j").drop("i", "j")


def pairwise_correlation(df: DataFrame, series: str, date: str, value: str, block: int = 512, date_slices: int | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of every pair of series over shared dates: ``series_1, series_2, n, corr``; ``anchors`` as in :func:`pairwise_sums`."""
    t = pairwise_sums(df, series, date, value, block, date_slices, centre=True, anchors=anchors)
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") ** 2 / n
    vy = F.col("syy") - F.col("sy") ** 2 / n
    return t.select("series_1", "series_2", n.cast("long").alias("n"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("corr"))


def target_correlation(df: DataFrame, y: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation of each numeric column with ``y``, one aggregation."""
    cols = [c for c in (cols or numeric_columns(df)) if c != y]
    row = df.agg(*[F.corr(c, y).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "corr")
