"""Joins that Spark has no single operator for, and checked forms of those it has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.operators.neighbours import nearest_other, within
from tabloom.operators.order import carry_last, null_safe_join
from tabloom.session import shuffled, small_side


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def is_unique(df: DataFrame, keys: Sequence[str]) -> bool:
    return duplicate_keys(df, keys).limit(1).count() == 0


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """Join that fails if the declared cardinality does not hold ('1:1', '1:m', 'm:1', 'm:m')."""
    l, r = validate.split(":")
    if l == "1" and not is_unique(left, keys):
        raise ValueError(f"left keys {list(keys)} are not unique")
    if r == "1" and not is_unique(right, keys):
        raise ValueError(f"right keys {list(keys)} are not unique")
    return left.join(right, list(keys), how)


def suffixed_full_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes=("_x", "_y")) -> DataFrame:
    def tag(df, s):
        return df.withColumnsRenamed({c: f"{c}{s}" for c in df.columns if c not in keys})

    return tag(left, suffixes[0]).join(tag(right, suffixes[1]), list(keys), "full")


def cross_values(df: DataFrame, grids: Mapping[str, Sequence]) -> DataFrame:
    """Every row with every combination of fixed value lists; lists are literals, so nothing is joined."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def cross_array(df: DataFrame, name: str, values: Column) -> DataFrame:
    return df.withColumn(name, F.explode(values))


def positional_join(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Predictions back to inputs by an explicit row id that both sides carry."""
    return checked_join(left, right, [row_id], "inner", "1:1")


def outer_fold(frames: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """One column per frame, keyed by ``keys``: union in long form and one pivot, not chained joins."""
    long = reduce(
        DataFrame.unionByName, [f.select(*keys, F.lit(n).alias("_m"), F.col(value).alias("_v")) for n, f in frames.items()]
    )
    return long.groupBy(*keys).pivot("_m", list(frames)).agg(F.first("_v", ignorenulls=True))


def join_star(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Fact with dimensions joined on the column each is keyed by; duplicate dimension keys are an error."""
    for key, dim in dims.items():
        if not is_unique(dim, [key]):
            raise ValueError(f"dimension key {key} is not unique")
        fact = fact.join(small_side(dim), key, "left")
    return fact


def dual_lookup(df: DataFrame, cols: Sequence[str], dim: DataFrame, key: str, value: str) -> DataFrame:
    """The same dimension looked up from several columns; adds ``<col>_<value>``."""
    d = small_side(dim.select(key, value))
    for c in cols:
        df = df.join(d.withColumnsRenamed({key: c, value: f"{c}_{value}"}), c, "left")
    return df


def _ticks(df: DataFrame, col: str) -> Column:
    """Times as whole seconds, dates as days, numbers as they are, rounded down."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_seconds(c.cast("timestamp"))
    return F.unix_date(c).cast("long") if isinstance(kind, T.DateType) else F.floor(c).cast("long")


def dyadic(low: Column, high: Column) -> Column:
    """The whole numbers from ``low`` to ``high`` as nodes ``(lev, at)`` of a binary tree: node ``at`` of a level covers ``2^lev`` numbers.

    At level k what is left begins at ``ceil(low / 2^k)`` and ends before ``floor((high + 1) / 2^k)``; an odd begin and an odd end are nodes,
    so an interval has at most two for each level up to that of its length.
    """
    k = F.sequence(F.lit(0), F.least(F.lit(61), F.ceil(F.log2(high - low + 2)).cast("int")))

    def node(i):
        a = -F.call_function("shiftright", -low, i)
        b = F.call_function("shiftright", high + 1, i)
        odd = lambda x: (x % 2) != 0
        left = F.when((a < b) & odd(a), F.struct(i.alias("lev"), a.alias("at")))
        right = F.when((a < b) & odd(b), F.struct(i.alias("lev"), (b - 1).alias("at")))
        return F.array(left, right)

    return F.when(low <= high, F.filter(F.flatten(F.transform(k, node)), lambda x: x.isNotNull()))


def _reached(spots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The points ``_p`` that lie in an interval, without the pairs.

    From level 1 on a node has two seconds or more, all of them inside each of its intervals: a point before the last of them ends ahead of every
    end, one after the first begins behind every begin, so the least begin and the greatest end tell.
    """
    wide = nodes.where("_rl > 0").groupBy("_rl", "_ra").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    ends = wide.unionByName(nodes.where("_rl = 0").distinct())
    hit = (F.col("_ll") == F.col("_rl")) & (F.col("_la") == F.col("_ra")) & (F.col("_p") >= F.col("_low")) & (F.col("_p") <= F.col("_high"))
    return spots.join(small_side(ends), hit, "left_semi").select("_p").distinct()


def range_join(left: DataFrame, point: str, right: DataFrame, low: str, high: str, how: str = "inner") -> DataFrame:
    """Rows with ``low <= point <= high``; ``how`` is inner or left.

    Intervals become nodes of a binary tree over time (seconds; days for dates), a point the nodes above it on the levels that intervals
    have, and these are joined by equality.  Every node of an interval lies inside it, so only pairs that belong together meet, but for
    points within the first and last second.  Rows with a NULL end, or with the ends the wrong way round, match nothing.
    """
    nodes = right.withColumn("_x", F.explode(dyadic(_ticks(right, low), _ticks(right, high))))
    nodes = nodes.select(*right.columns, F.col("_x.lev").alias("_rl"), F.col("_x.at").alias("_ra"))
    levels = sorted(r[0] for r in nodes.select("_rl").distinct().collect())  # 62 at the most
    above = F.array(*[F.struct(F.lit(i).alias("lev"), F.shiftright("_at", i).alias("at")) for i in levels]) if levels else F.lit(None).cast("array<struct<lev:int,at:bigint>>")
    spread = left.withColumn("_at", _ticks(left, point)).withColumn("_x", F.explode(above)).select(*left.columns, F.col("_x.lev").alias("_ll"), F.col("_x.at").alias("_la"))
    hit = (F.col("_ll") == F.col("_rl")) & (F.col("_la") == F.col("_ra")) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    out = spread.join(small_side(nodes), hit).drop("_ll", "_la", "_rl", "_ra")
    if how == "left":
        reached = _reached(spread.select(F.col(point).alias("_p"), "_ll", "_la").distinct(), nodes.select(F.col(low).alias("_low"), F.col(high).alias("_high"), "_rl", "_ra"))
        out = out.unionByName(left.join(reached, F.col(point) == F.col("_p"), "left_anti"), allowMissingColumns=True)
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    direction: str = "backward",
    allow_exact: bool = True,
    prefix: str = "",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Nearest right row on or before (``backward``) or on or after (``forward``) each left row.

    Both sides are put in one time order and the last right row is carried along it, slice by slice.
    Right columns other than ``by`` come back with ``prefix``; the right time is ``<prefix><on>_right``.
    Of right rows with the same time the last one in the order of ``ties`` counts backward, the first one forward; what ties there, too,
    or without ``ties``, goes by a hash of the row, so that the choice is always the same.
    """
    by = list(by)
    forward = direction == "forward"
    rest = [c for c in right.columns if c not in by]
    payload = F.struct(*[F.col(c).alias(c) for c in rest])
    # Among equal times the right row must be met first if exact matches count, last if not.
    right_side = 1 if forward == allow_exact else -1
    tie = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.xxhash64(*rest).alias("h"))
    nothing = lambda c: F.lit(None).cast(right.select(c).schema[0].dataType)
    l = left.withColumns({"_t": F.col(on), "_side": F.lit(0), "_tie": nothing(tie), "_right": nothing(payload)})
    r = right.select(*by, F.col(on).alias("_t"), F.lit(right_side).alias("_side"), tie.alias("_tie"), payload.alias("_right"))
    out = carry_last(l.unionByName(r, allowMissingColumns=True), ["_t", "_side", "_tie"], ["_right"], by, forward)
    names = {c: (f"{prefix}{on}_right" if c == on else f"{prefix}{c}") for c in rest}
    return out.filter("_side = 0").select(
        *left.columns, *[F.col(f"last__right.{c}").alias(n) for c, n in names.items()]
    )


def rolling_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Backward as-of join in which the first value also covers the time before it; ``ties`` as in :func:`asof_join`, the value by default."""
    by, ties = list(by), list(ties) or [value]
    first = right.groupBy(*by).agg(F.min_by(value, F.struct(on, *ties)).alias("_first"))
    out = asof_join(left, right.select(*dict.fromkeys([*by, on, value, *ties])), by, on, ties=ties).select(*left.columns, value)
    return null_safe_join(out, first, by, "left").withColumn(value, F.coalesce(value, "_first")).drop("_first")


def vicinity(
    df: DataFrame, by: Sequence[str], coords: Sequence[str], r: float, partials: Mapping[str, tuple[Column, object]], metric: str = "l1"
) -> DataFrame:
    """Aggregates over all other rows within ``r``, per distinct position.

    ``partials`` maps a name to (aggregate over the rows of one position, merging aggregate).  The
    position's own rows are included; the caller removes the row itself.
    """
    here = df.groupBy(*by, *coords).agg(*[c.alias(n) for n, (c, _) in partials.items()])
    return within(here, by, coords, [r], {n: merge for n, (_, merge) in partials.items()}, metric=metric).drop("r")


def radius_counts(df: DataFrame, by: Sequence[str], coords: Sequence[str], radii: Mapping[str, float], metric: str = "l1") -> DataFrame:
    """``df`` with the number of other rows of its group within each radius; all radii come from one pass.  Without a place they are NULL."""
    here = df.groupBy(*by, *coords).agg(F.count(F.lit(1)).alias("k"))
    near = within(here, by, coords, list(radii.values()), {"k": F.sum}, metric=metric)
    wide = near.groupBy(*by, *coords).agg(*[F.sum(F.when(F.col("r") == float(r), F.col("k"))).alias(n) for n, r in radii.items()])
    return null_safe_join(df, shuffled(wide), [*by, *coords], "left").withColumns({n: F.col(n) - 1 for n in radii})


def nearest_same(df: DataFrame, by: Sequence[str], category: str, coords: Sequence[str], metric: str = "l1", none: float = 99999.0) -> DataFrame:
    """Distance to the closest other position of the same group and category (``nearest``), ``none`` without one."""
    keys = [*by, category, *coords]
    found = nearest_other(df.select(*keys), [*by, category], coords, metric)
    return null_safe_join(df, shuffled(found), keys, "left").fillna({"nearest": none})


def cosine_join(triples: DataFrame, query: DataFrame, entity: str, item: str, score: str) -> DataFrame:
    """Cosine of every entity's sparse vector with one query vector (``item``, ``score``)."""
    norms = triples.groupBy(entity).agg(F.sqrt(F.sum(F.col(score) ** 2)).alias("norm"))
    qnorm = query.agg(F.sqrt(F.sum(F.col(score) ** 2)).alias("qnorm"))
    q = small_side(query.select(item, F.col(score).alias("_q")))
    dots = triples.join(q, item).groupBy(entity).agg(F.sum(F.col(score) * F.col("_q")).alias("dot"))
    return (
        dots.join(norms, entity)
        .crossJoin(F.broadcast(qnorm))
        .select(entity, F.try_divide(F.col("dot"), F.col("norm") * F.col("qnorm")).alias("similarity"))
    )


def lattice(df: DataFrame, flags: Sequence[str], key: str = "sub") -> DataFrame:
    """Each row with every subset of its 0/1 flags, as a bit number (bit i = flag i)."""
    if len(flags) > 20:
        raise ValueError("the lattice has 2^k members; k must stay small")
    bits = reduce(lambda a, b: a + b, [F.col(f).cast("int") * (1 << i) for i, f in enumerate(flags)])
    subs = F.filter(F.sequence(F.lit(0), bits), lambda s: s.bitwiseAND(bits) == s)
    return df.withColumn("bits", bits).withColumn(key, F.explode(subs))


def windowed_relationship(
    primary: DataFrame,
    secondary: DataFrame,
    keys: Sequence[str],
    point: str,
    when: str,
    measures: Mapping[str, str],
    first_day: int = -14,
    last_day: int = -1,
) -> DataFrame:
    """Aggregates of secondary rows in a window of days before each primary's prediction point.

    The point is rounded down to its day.  Secondary rows are first summed per (key, day), then each
    day contributes to the fixed number of days whose window covers it; so the join is an equi-join
    on (key, day) whatever the number of rows per key.
    """
    keys = list(keys)
    day = secondary.groupBy(*keys, F.to_date(when).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(c).alias(f"_{k}_{n}") for n, c in measures.items() for k, f in (("s", F.sum), ("lo", F.min), ("hi", F.max))],
    )
    spread = day.withColumn("_p", F.explode(F.sequence(F.date_add("_d", -last_day), F.date_add("_d", -first_day))))
    feats = spread.groupBy(*keys, "_p").agg(
        F.sum("_n").alias("count"),
        *[
            c
            for n in measures
            for c in (
                F.sum(f"_s_{n}").alias(f"sum_{n}"),
                F.min(f"_lo_{n}").alias(f"min_{n}"),
                F.max(f"_hi_{n}").alias(f"max_{n}"),
            )
        ],
    )
    out = null_safe_join(primary.withColumn("_p", F.to_date(point)), feats, [*keys, "_p"], "left").drop("_p")
    return out.fillna({"count": 0})
