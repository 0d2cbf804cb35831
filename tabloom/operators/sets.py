"""Unions, differences and table comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.operators.order import group_transform, null_safe_join


def union_fill(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_latest(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Rows of the newest ``t`` per key; ties stay."""
    return group_transform(df, keys, {"_last": F.max(t)}).filter(F.col(t) == F.col("_last")).drop("_last")


def _missing(c: Column, dtype: str) -> Column:
    return c.isNull() | F.isnan(c) if dtype in ("double", "float") else c.isNull()


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per column: where it exists, missing counts on both sides, and rows that differ on equal keys.

    One full join and one aggregation for all columns; missing on both sides counts as equal.
    """
    types = dict(a.dtypes) | dict(b.dtypes)
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    l = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in shared], F.lit(True).alias("_a"))
    r = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in shared], F.lit(True).alias("_b"))
    j = l.join(r, list(keys), "full")
    cells = []
    for c in shared:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        mx, my = _missing(x, types[c]), _missing(y, types[c])
        differs = F.when(F.col("_a") & F.col("_b"), ~(mx & my) & (mx | my | ~x.eqNullSafe(y)))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col("_a") & mx).alias("missing_a"),
                F.count_if(F.col("_b") & my).alias("missing_b"),
                F.count_if(differs).alias("differ"),
            )
        )
    both = j.agg(F.array(*cells).alias("r")).select(F.inline("r")).withColumn("place", F.lit("both"))
    spark = a.sparkSession
    only = [(c, "a") for c in a.columns if c not in b.columns] + [(c, "b") for c in b.columns if c not in a.columns]
    rest = spark.createDataFrame(only, "column string, place string")
    return both.unionByName(rest, allowMissingColumns=True)


def coldstart_weights(test: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``weight`` 1 for test keys that never occur in training, 0 otherwise."""
    seen = train.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return null_safe_join(test, seen, keys, "left").withColumn("weight", F.when(F.col("_seen"), 0).otherwise(1)).drop("_seen")


def mirror_pairs(df: DataFrame, side_a: Sequence[str], side_b: Sequence[str], names: Sequence[str], won: Column, home: Column) -> DataFrame:
    """Two rows per game, sides swapped, with won and home flags flipped; one pass."""
    own = [f"own_{n}" for n in names]
    opp = [f"opp_{n}" for n in names]

    def row(x, y, w, h):
        cols = [F.col(c).alias(n) for c, n in zip([*x, *y], [*own, *opp])]
        return F.struct(*cols, w.cast("int").alias("won"), h.cast("int").alias("home"))

    rest = [c for c in df.columns if c not in (*side_a, *side_b)]
    return df.select(*rest, F.inline(F.array(row(side_a, side_b, won, home), row(side_b, side_a, ~won, ~home))))


def common_keys(frames: Sequence[DataFrame], key: str, blocked: Sequence = ()) -> DataFrame:
    """Keys present in every table, minus a block list."""
    tagged = [f.select(key).distinct().withColumn("_i", F.lit(i)) for i, f in enumerate(frames)]
    counts = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.filter(F.col("_n") == len(frames)).select(key)
    return out.filter(~F.col(key).isin(list(blocked))) if blocked else out


def restrict(frames: Sequence[DataFrame], key: str, blocked: Sequence = ()) -> list[DataFrame]:
    keys = common_keys(frames, key, blocked)
    return [f.join(keys, key, "left_semi") for f in frames]
