"""Model effects on data: dependence grids, curves, attribution, options and assortments.

A scorer is any function DataFrame -> DataFrame that adds a ``score`` column row by row.
Grids are short literal arrays exploded per row, so nothing is joined and aggregation starts map-side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.operators.joins import lattice
from tabloom.operators.order import hash_order, quantile_list, row_positions
from tabloom.session import materialize, small_side

Scorer = Callable[[DataFrame], DataFrame]


def pdp_grid(df: DataFrame, feature: str, kind: str = "numeric", points: int = 25, limit: int = 50) -> list:
    """Grid of a feature: ``numeric`` 25 quantiles from .05 to .95, or the distinct values if there
    are no more than ``points``; ``even`` steps between the 1st and 99th percentile; ``categorical``
    the ``limit`` most frequent values."""
    if kind == "categorical":
        top = df.filter(F.col(feature).isNotNull()).groupBy(feature).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), feature).limit(limit)
        return [r[0] for r in top.collect()]
    if kind == "even":
        lo, hi = quantile_list(df, feature, [0.01, 0.99])
        return [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    few = df.select(feature).filter(F.col(feature).isNotNull()).distinct().limit(points + 1).collect()
    if len(few) <= points:
        return sorted(r[0] for r in few)
    return sorted(set(quantile_list(df, feature, [0.05 + 0.9 * i / (points - 1) for i in range(points)])))


def _spread(df: DataFrame, feature: str, grid: Sequence) -> DataFrame:
    t = dict(df.dtypes)[feature]
    return df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(v) for v in grid]).cast(f"array<{'double' if t != 'string' else t}>")))


def pdp(df: DataFrame, scorer: Scorer, f1: str, grid1: Sequence, f2: str | None = None, grid2: Sequence | None = None) -> DataFrame:
    """Mean, deviation and count of the score at every grid value (or pair of values)."""
    x = _spread(df, f1, grid1)
    keys = [f1]
    if f2:
        x, keys = _spread(x, f2, grid2), [f1, f2]
    return scorer(x).groupBy(*keys).agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count(F.lit(1)).alias("n")
    )


def top_and_other(df: DataFrame, col: str, k: int, other: str = "OTHER") -> DataFrame:
    """Keep the ``k`` most frequent values of a text column, the rest becomes OTHER."""
    top = pdp_grid(df, col, "categorical", limit=k)
    return df.withColumn(col, F.when(F.col(col).isin(top), F.col(col)).otherwise(F.lit(other)))


def ice(df: DataFrame, scorer: Scorer, feature: str, grid: Sequence, row_id: str) -> DataFrame:
    """Curve per row, raw and relative to the curve's first point.

    The first point is scored from the same row, so no window or join is needed.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(float(grid[0])).alias("_g0"), F.lit(float(v)).alias("_g")) for v in grid]))
    wide = df.select("*", pairs)
    at = scorer(wide.drop(feature).withColumnRenamed("_g", feature)).withColumnRenamed("score", "_s")
    base = scorer(at.withColumnRenamed(feature, "_g").withColumnRenamed("_g0", feature))
    return base.select(row_id, F.col("_g").alias(feature), F.col("_s").alias("score"), (F.col("_s") - F.col("score")).alias("relative"))


def area_grid(areas: DataFrame, lon: str, lat: str, attributes: DataFrame, key: str, constants: Mapping[str, Sequence]) -> DataFrame:
    """Positions of areas with the attributes of their area and constant settings, ready for scoring."""
    g = areas.select(key, lon, lat).distinct().join(small_side(attributes), key)
    for name, values in constants.items():
        g = g.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return g


def attribution(df: DataFrame, scorer: Scorer, flags: Sequence[str], row_id: str) -> DataFrame:
    """Share of each touch point: sum of scores with it minus without it over all subsets of the
    touch points used, 0 if unused, divided by the total with the baseline."""
    sub = lattice(df, flags).withColumnsRenamed({f: f"_used_{f}" for f in flags})
    for i, f in enumerate(flags):
        sub = sub.withColumn(f, F.shiftright("sub", i).bitwiseAND(F.lit(1)))
    s = scorer(sub)
    sign = {f: F.sum(F.when(F.col(f) == 1, F.col("score")).otherwise(-F.col("score"))) for f in flags}
    g = s.groupBy(row_id).agg(
        F.max(F.when(F.col("sub") == 0, F.col("score"))).alias("_base"),
        *[F.when(F.max(f"_used_{f}") == 1, sign[f]).otherwise(0.0).alias(f"_c_{f}") for f in flags],
    )
    total = reduce(lambda a, b: a + b, [F.col("_base"), *[F.col(f"_c_{f}") for f in flags]])
    return g.select(
        row_id, F.try_divide("_base", total).alias("contrib_baseline"), *[F.try_divide(F.col(f"_c_{f}"), total).alias(f"contrib_{f}") for f in flags]
    )


def _decoded(options: Mapping[str, Sequence], number: Column) -> dict[str, Column]:
    """Option values of a combination by its number, the first option varying fastest."""
    out = {}
    for name, values in options.items():
        out[name] = F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))
        number = F.floor(number / len(values))
    return out


def best_option_by(df: DataFrame, options: Mapping[str, Sequence], score: Callable[[Mapping[str, Column]], Column], row_id: str) -> DataFrame:
    """:func:`best_option` for a score that is an expression of the option columns: found inside the row, without a shuffle.

    The options are nested loops over literal lists, so a combination is a number, its score, and only the best one is decoded.
    Rows are dealt evenly first: a row is few bytes and much work, and tasks are cut by bytes.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def scores(names: list[str], chosen: dict[str, Column]) -> Column:
        *rest, last = names
        values = F.array(*[F.lit(v) for v in options[last]])
        if not rest:
            return F.transform(values, lambda v: score(chosen | {last: v}))
        return F.flatten(F.transform(values, lambda v: scores(rest, chosen | {last: v})))

    every = df.select(row_id, scores(list(options), {}).alias("_s")).withColumn("score", F.array_max("_s"))
    best = every.select(row_id, "score", (F.array_position("_s", F.col("score")) - 1).alias("_o"))
    return best.select(row_id, *[c.alias(n) for n, c in _decoded(options, F.col("_o")).items()], "score")


def best_option(df: DataFrame, options: Mapping[str, Sequence], scorer: Scorer, row_id: str) -> DataFrame:
    """Best-scoring combination of option values per row; equal scores go to the first combination.

    Combinations are numbered and decoded by arithmetic; the maximum is merged before the shuffle.
    """
    total = math.prod(len(v) for v in options.values())
    x = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    x = x.withColumns(_decoded(options, F.col("_o")))
    best = F.max_by(F.struct(*options, "score"), F.struct(F.col("score"), -F.col("_o")))
    return scorer(x).groupBy(row_id).agg(best.alias("_b")).select(row_id, "_b.*")


def item_sets(df: DataFrame, items: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """All combinations of a short item list as rows: ``set_id, item_set`` and one 0/1 column per item."""
    if len(items) > 20:
        raise ValueError("too many items for full combinations")
    spark = df.sparkSession
    out = spark.range(1, 1 << len(items)).withColumnRenamed("id", "set_id").filter(F.bit_count("set_id").isin(list(sizes)))
    return out.select("set_id", *[F.shiftright("set_id", i).bitwiseAND(F.lit(1)).cast("int").alias(c) for i, c in enumerate(items)])


def assortment_value(sets: DataFrame, units: DataFrame, items: Sequence[str], item: str, value: str) -> DataFrame:
    """Summed predicted units of each combination, ranked; ``units`` has one row per item."""
    row = units.groupBy().pivot(item, list(items)).agg(F.sum(value))
    row = row.toDF(*[f"_u{i}" for i in range(len(items))])
    total = reduce(lambda a, b: a + b, [F.col(c) * F.coalesce(F.col(f"_u{i}"), F.lit(0.0)) for i, c in enumerate(items)])
    scored = materialize(sets.crossJoin(F.broadcast(row)).select("set_id", total.alias("value")))  # ranking reads it several times
    return row_positions(scored, ["value", "set_id"], name="rank", descending=True)


def permute_column(df: DataFrame, col: str, row_id: str, seed: int = 0) -> DataFrame:
    """The column's values in another row order, all else fixed.

    Two seeded hash orders give each row a place and each value a place; they meet by position.
    """
    h = df.withColumns({"_h1": hash_order(row_id, seed=seed), "_h2": hash_order(row_id, seed=seed + 1)})
    rows = row_positions(h.drop(col, "_h2"), ["_h1", row_id], name="_pos").drop("_h1")
    vals = row_positions(h.select("_h2", row_id, col), ["_h2", row_id], name="_pos").select("_pos", col)
    return rows.join(vals, "_pos").select(*df.columns)
