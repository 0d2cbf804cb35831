"""Column expressions and simple frame transforms; all stay inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.operators.order import group_transform, null_safe_join
from tabloom.spec import numeric_columns


def select_matching(df: DataFrame, regex: str | None = None, negate: bool = False, numeric: bool = False) -> DataFrame:
    """Columns whose name matches (or does not), optionally only numeric ones."""
    pool = numeric_columns(df) if numeric else df.columns
    return df.select(*[c for c in pool if regex is None or bool(re.search(regex, c)) != negate])


def add_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


# Characters that may not occur in a column name.
BAD_NAME_CHARS = '-$.{}"'


def clean_name(name: str) -> str:
    return re.sub(f"[{re.escape(BAD_NAME_CHARS)}]", "_", name.strip()) or "_blank"


def sanitize_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names collide after cleaning")
    return df.toDF(*names)


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf"))


def finite_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [is_finite(F.col(c).cast("double")) for c in cols]))


INT_TYPES = (("tinyint", 8), ("smallint", 16), ("int", 32))


def downcast(df: DataFrame, aggressive: bool = False) -> DataFrame:
    """Smallest integer type whose range strictly contains min and max; doubles to float.

    One aggregation finds all ranges.  Doubles outside the half-precision range are narrowed only
    if ``aggressive`` (Spark has no half-precision type, so float is the narrowest).
    """
    cols = numeric_columns(df)
    if not cols:
        return df
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    casts = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        if lo is None:
            continue
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            limit = 3.4e38 if aggressive else 65504.0
            if -limit < lo and hi < limit:
                casts[c] = F.col(c).cast("float")
        else:
            name = next((t for t, b in INT_TYPES if -(2 ** (b - 1)) < lo and hi < 2 ** (b - 1) - 1), None)
            if name:
                casts[c] = F.col(c).cast(name)
    return df.withColumns(casts)


def make_key(df: DataFrame, cols: Sequence[str], sep: str = "_", convert: bool = True) -> Column:
    """Cells joined with ``sep``; a missing cell prints as ``nan``."""
    if not convert and any(not isinstance(df.schema[c].dataType, T.StringType) for c in cols):
        raise TypeError("key columns must be strings unless convert=True")
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def map_values(col: Column, mapping: Mapping) -> Column:
    """Dictionary replacement; values that are not keys stay."""
    out = F
    for k, v in mapping.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(col)


def impute(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """``{column: constant | 'mean' | 'median'}``; statistics come from one aggregation row."""
    stats = {c: how for c, how in spec.items() if how in ("mean", "median")}
    consts = {c: v for c, v in spec.items() if c not in stats}
    if stats:
        from tabloom.operators.order import quantiles

        means = [c for c, h in stats.items() if h == "mean"]
        medians = [c for c, h in stats.items() if h == "median"]
        values = {}
        if means:
            row = df.agg(*[F.avg(c) for c in means]).first()
            values |= dict(zip(means, row))
        if medians:
            long = df.select(*[F.col(c).cast("double") for c in medians]).unpivot([], medians, "_c", "_v")
            values |= {r["_c"]: r["q0"] for r in quantiles(long, "_v", [0.5], ["_c"]).collect()}
        df = df.fillna({c: v for c, v in values.items() if v is not None})
    return df.fillna(consts) if consts else df


def failing_tokens(df: DataFrame, col: str) -> DataFrame:
    """Distinct texts that are not numbers, with counts."""
    return df.filter(F.col(col).isNotNull() & F.col(col).try_cast("double").isNull()).groupBy(
        F.col(col).alias("token")
    ).agg(F.count(F.lit(1)).alias("n"))


def coalesce_variants(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Plain metric where present, its weighted twin otherwise."""
    return df.withColumns({c: F.coalesce(c, w) for c, w in pairs.items()})


def text_clean(col: Column, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    return F.trim(F.regexp_replace(F.lower(col), pattern, " "))


def parse_composite(col: Column, default: str = "all_series") -> dict[str, Column]:
    """``..._FD:a_FDW:b_Cluster-c`` -> forecast distance, derivation window and cluster."""

    def part(pattern):
        return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))

    return {
        "fd": part(r"_FD:([^_]*)"),
        "fdw": part(r"_FDW:([^_]*)"),
        "cluster": F.coalesce(part(r"_Cluster-(.*)$"), F.lit(default)),
    }


def count_substring(col: Column, text: str) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(re.escape(text))), F.lit(0))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"\S+"))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col, F.lit(lo)), F.lit(hi))


def nested(col: Column, path: str, as_type: str = "double") -> Column:
    """Value at a JSON path such as ``$.a['R Squared']``; NULL if absent or of another type."""
    return F.get_json_object(col, path).try_cast(as_type)


def spread_pairs(arr: str, k: int, name: str = "name", value: str = "value") -> list[Column]:
    """First ``k`` entries of an array of pairs as ``label1, proba1, ...``."""
    out = []
    for i in range(k):
        out += [
            F.get(F.col(arr), F.lit(i))[name].alias(f"label{i + 1}"),
            F.get(F.col(arr), F.lit(i))[value].alias(f"proba{i + 1}"),
        ]
    return out


def pick_class_value(arr: Column, label, name: str = "label", value: str = "value") -> Column:
    return F.get(F.filter(arr, lambda x: x[name] == F.lit(label)), F.lit(0))[value]


def row_argmax(cols: Sequence[str]) -> Column:
    """Name of the first column that attains the row maximum."""
    top = F.greatest(*cols)
    return reduce(lambda acc, c: F.when(F.col(c) == top, F.lit(c)).otherwise(acc), reversed(cols), F.lit(None))


def row_rank(col: Column, others: Sequence[str]) -> Column:
    """Rank (1 = largest) of ``col`` among ``others``, ties averaged and truncated."""
    larger = reduce(lambda a, b: a + b, [F.when(F.col(c) > col, 1).otherwise(0) for c in others])
    equal = reduce(lambda a, b: a + b, [F.when(F.col(c) == col, 1).otherwise(0) for c in others])
    return F.floor(larger + (equal + 1) / 2).cast("int")


def is_in_top_n(actual: Column, classes: Mapping[str, str], n: int) -> Column:
    """True class among the ``n`` most probable; ``classes`` maps class value -> probability column."""
    p = reduce(lambda acc, kv: F.when(actual == kv[0], F.col(kv[1])).otherwise(acc), classes.items(), F.lit(None))
    return row_rank(p, list(classes.values())) <= n


def likely_categorical(df: DataFrame, cols: Sequence[str], thresh: float = 0.05, approx: bool = False) -> DataFrame:
    """One row per column: distinct share and the flag; one pass for all columns.

    The exact form counts distinct (column, value) pairs in long form, so that no column's values
    meet in one task; ``approx`` uses a sketch per column.
    """
    if approx:
        row = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("n_distinct"), F.count(c).alias("n")) for c in cols]
        t = df.agg(F.array(*row).alias("r")).select(F.inline("r"))
    else:
        long = df.select(*[F.col(c).cast("string") for c in cols]).unpivot([], list(cols), "column", "v")
        t = long.filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))
        t = t.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("k").alias("n"))
    share = F.col("n_distinct") / F.col("n")
    return t.select("column", "n_distinct", "n", (share < thresh).alias("categorical"))


def messy_number(col: Column) -> Column:
    return F.regexp_replace(col, ",", "").try_cast("double")


def percent_number(col: Column) -> Column:
    return F.regexp_replace(F.trim(col), "%$", "").try_cast("double")


def ordinal_date(col: Column) -> Column:
    """``March 3rd 2019, 10:00:00``; the suffix is removed only after a digit, so August survives."""
    return F.try_to_timestamp(F.regexp_replace(col, r"(\d)(st|nd|rd|th)", "$1"), F.lit("MMMM d yyyy, HH:mm:ss"))


def classify(col: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Ordered regex rules; the last rule that matches wins."""
    out = F
    for pattern, label in reversed(rules):
        out = out.when(col.rlike(pattern), label)
    return out.otherwise(default)


def squash_negatives(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """Scores below zero divided by the size of the group minimum, so they end at -1."""
    out = group_transform(df, by, {"_min": F.min(score)})
    return out.withColumn(
        score, F.when(F.col(score) < 0, F.col(score) / F.abs("_min")).otherwise(F.col(score))
    ).drop("_min")


def parse_interval(col: Column) -> dict[str, Column]:
    """``(a, b]`` -> lower and upper number."""
    return {
        "lower": F.trim(F.regexp_extract(col, r"^[\[\(]([^,]*),", 1)).try_cast("double"),
        "upper": F.trim(F.regexp_extract(col, r",([^,\]\)]*)[\]\)]$", 1)).try_cast("double"),
    }


def repair_json(col: Column) -> Column:
    """Printed Python dictionary -> JSON text; blank -> ``{}``."""
    fixed = F.regexp_replace(col, r"\bu'", "'")
    fixed = F.regexp_replace(fixed, r"\bNone\b", "null")
    fixed = F.regexp_replace(fixed, r"\bTrue\b", "true")
    fixed = F.regexp_replace(fixed, r"\bFalse\b", "false")
    fixed = F.replace(fixed, F.lit("'"), F.lit('"'))
    return F.when(F.trim(col) == "", F.lit("{}")).otherwise(fixed)


def basename(col: Column) -> Column:
    return F.regexp_extract(col, r"([^/]*)$", 1)


def extract_params(col: Column, keys: Sequence[str], missing: float = 0.0) -> dict[str, Column]:
    """Numbers of ``key=value`` items inside a text."""
    return {
        k: F.coalesce(F.regexp_extract(col, rf"\b{re.escape(k)}=(-?[0-9.]+)", 1).try_cast("double"), F.lit(missing))
        for k in keys
    }


def encode_ids(df: DataFrame, cols: Sequence[str], prefix: str = "x") -> DataFrame:
    """Each distinct value -> prefix + its ordinal in sorted order, joined back per column."""
    from tabloom.operators.order import row_positions

    for c in cols:
        ids = row_positions(df.select(c).filter(F.col(c).isNotNull()).distinct(), [c], name="_id")
        df = null_safe_join(df, ids, [c], "left").withColumn(c, F.concat(F.lit(prefix), F.col("_id"))).drop("_id")
    return df


def calendar_keys(ts: Column) -> dict[str, Column]:
    """Hour, day-of-week (Sunday = 1) and month combined into text keys."""
    h, d, m = [F.concat(F.lit(p), f(ts)) for p, f in (("H", F.hour), ("D", F.dayofweek), ("M", F.month))]
    return {
        "hour_day": F.concat(h, d),
        "hour_month": F.concat(h, m),
        "hour_day_month": F.concat(h, d, m),
        "day_month": F.concat(d, m),
    }


def lead_value(col: str, by: Sequence[str], order: str) -> Column:
    return F.lead(col).over(Window.partitionBy(*by).orderBy(order))
