"""Streams whose results are kept by key and never rewritten, however late rows come.

Three forms.  *Partials*: every micro-batch is aggregated by itself and its partial results are appended; a reader merges them by key, so no state
is kept and no row is too late.  *Expiring state*: a processor remembers keys for a time that bounds its state, and emits what is new; a key
that comes back after it was forgotten is emitted once more, which the reader's merge takes out.  *Delta join*: new rows of either side are
joined with all that the other side has landed, in the days that can match.

Each batch writes a folder of its own, named by its number, and replaces it if it is repeated; so a failed batch leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabloom.operators.order import carry_last, even_keys, prefix_sum
from tabloom.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(stream: DataFrame, path: str, batch: Callable[[DataFrame], DataFrame], checkpoint: str | None = None) -> list[dict]:
    """Everything available, batch by batch; ``batch`` of each goes to its own folder of ``path``.  Gives the progress of the last batches."""
    spark = stream.sparkSession

    def write(df: DataFrame, number: int) -> None:
        batch(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    checkpoint = checkpoint or scratch_path(spark, "stream-state")
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    query.awaitTermination()
    return list(query.recentProgress)


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


# ---------------------------------------------------------------- partial aggregates

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Mergeable:
    """Aggregates made of parts: ``parts`` maps a name to (sum, min or max; value), ``finish`` a result to a column over these names."""

    parts: Mapping[str, tuple[str, Column]]
    finish: Mapping[str, Column] = field(default_factory=dict)

    def start(self, df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
        return df.groupBy(*keys).agg(*[MERGES[kind](c).alias(n) for n, (kind, c) in self.parts.items()])

    def merge(self, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
        m = parts.groupBy(*keys).agg(*[MERGES[kind](n).alias(n) for n, (kind, _) in self.parts.items()])
        return m.select(*keys, *[c.alias(n) for n, c in self.finish.items()]) if self.finish else m


def service(value: str) -> Mergeable:
    """Number, mean and largest value."""
    v = F.col(value)
    parts = {"n": ("sum", F.lit(1)), "_s": ("sum", v), "_k": ("sum", v.isNotNull().cast("long")), "max_value": ("max", v)}
    return Mergeable(parts, {"n": F.col("n"), "mean_value": F.try_divide("_s", "_k"), "max_value": F.col("max_value")})


def accuracy(actual: Column, predicted: Column, baseline: float) -> Mergeable:
    """Root mean squared error with its baseline and the change in percent."""
    gap = (actual - predicted) ** 2
    value = F.sqrt(F.try_divide("_s", "_k"))
    finish = {"n": F.col("n"), "value": value, "baseline": F.lit(baseline), "pct_change": 100 * F.try_divide(value - baseline, F.lit(baseline))}
    return Mergeable({"n": ("sum", F.lit(1)), "_s": ("sum", gap), "_k": ("sum", gap.isNotNull().cast("long"))}, finish)


def window_partials(df: DataFrame, t: str, keys: Sequence[str], what: Mergeable, window: str, slide: str | None = None) -> DataFrame:
    """Parts by tumbling or sliding window and ``keys`` of one batch: ``start, end, keys, parts``."""
    w = F.window(t, window, slide) if slide else F.window(t, window)
    return what.start(df, [w.alias("_w"), *keys]).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *what.parts)


def window_stats(stream: DataFrame, t: str, keys: Sequence[str], what: Mergeable, window: str, slide: str | None = None, path: str | None = None) -> DataFrame:
    """``start, end, keys`` and results of ``what`` for all windows of event time, whatever the order in which rows came."""
    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, "partials")
    land(stream, path, lambda df: window_partials(df, t, keys, what, window, slide))
    return what.merge(landed(spark, path), ["start", "end", *keys])


def session_stats(stream: DataFrame, t: str, keys: Sequence[str], value: str, gap: str, path: str | None = None) -> DataFrame:
    """Sessions by ``keys``: rows no further apart than ``gap``.  The sessions of the batches are joined where they overlap or touch."""
    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, "sessions")
    keys = list(keys)

    def batch(df: DataFrame) -> DataFrame:
        g = df.groupBy(F.session_window(t, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        return g.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n", "total")

    land(stream, path, batch)
    parts = landed(spark, path)
    even = even_keys(parts, keys)
    edges = parts.select(*keys, F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(parts.select(*keys, F.col("end").alias("at"), F.lit(-1).alias("d")))
    open_ = prefix_sum(edges, "at", {"d": F.col("d"), "begins": F.greatest(F.col("d"), F.lit(0))}, keys, even=even)
    first = open_.where((F.col("cum_d") - F.col("d") == 0) & (F.col("begins") > 0)).select(*keys, F.col("at").alias("start"), F.col("at").alias("_first"))
    marked = parts.withColumns({"_first": F.lit(None).cast(parts.schema["start"].dataType), "_side": F.lit(1)})
    both = marked.unionByName(first.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    found = carry_last(both, ["start", "_side"], ["_first"], keys, even=even).where("_side = 1")
    return found.groupBy(F.col("last__first").alias("start"), *keys).agg(F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def drift_many(stream: DataFrame, t: str, edges: Mapping[str, Sequence[float]], shares: Mapping[str, Sequence[float]], window: str = "1 day", path: str | None = None) -> DataFrame:
    """``start, feature, n, psi`` of many columns in one job, the target among them if it is named.

    ``edges`` are a column's inner bin edges and ``shares`` the reference's part in each bin, as ``jobs.reference_bins`` gives them.  The target
    is one more column; its window should be a day at the least.  Empty shares count as 1e-6.
    """
    from tabloom.streaming.jobs import bin_of

    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, "drift")

    def batch(df: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), bin_of(F.col(c), e)).alias("bin")) for c, e in edges.items()]
        long = df.select(F.window(t, window).start.alias("start"), F.inline(F.array(*cells))).where("bin is not null")
        return long.groupBy("start", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))

    land(stream, path, batch)
    bins = landed(spark, path).groupBy("start", "feature", "bin").agg(F.sum("n").alias("n"))
    wide = bins.groupBy("start", "feature").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("c"))
    expected = F.create_map(*[x for c, s in shares.items() for x in (F.lit(c), F.array(*[F.lit(max(float(v), 1e-6)) for v in s]))])
    terms = F.transform(expected[F.col("feature")], lambda e, i: F.struct(e.alias("e"), F.greatest(F.coalesce(F.try_element_at("c", i), F.lit(0)) / F.col("n"), F.lit(1e-6)).alias("a")))
    psi = F.aggregate(terms, F.lit(0.0), lambda s, x: s + (x.a - x.e) * F.ln(x.a / x.e))
    return wide.select("start", "feature", "n", psi.alias("psi"))


# ---------------------------------------------------------------- state that expires


class Lowest(StatefulProcessor):
    """Emits the least time of each key, and again whenever a lesser one comes.  A timer forgets a key ``keep_ms`` after its last rows arrived."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()[0] if self.first.exists() else None
        least, arrived = known, 0
        for df in rows:
            times = df["us"].dropna()
            arrived = max(arrived, int(df["arrived"].max().timestamp() * 1000))
            if len(times) and (least is None or times.min() < least):
                least = int(times.min())
        if least is None:
            yield pd.DataFrame({"id": [key[0]], "us": pd.array([None], "Int64")})
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(arrived + self.keep_ms)
        if least != known:
            self.first.update((least,))
            yield pd.DataFrame({"id": [key[0]], "us": [least]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, t: str, keep_ms: int = 86_400_000, path: str | None = None, seen: list | None = None) -> DataFrame:
    """``key, first``: the first time of each key; ``seen`` takes the progress of the batches.

    State holds the keys that had rows in the last ``keep_ms`` by the clock of arrival, and saves what they would emit again; a row's own time never
    makes it too late.  NULL keys are a key, and a key that only has NULL times has a NULL first.
    """
    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, "first-seen")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select(F.col(key).alias("id"), F.unix_micros(F.col(t).cast("timestamp")).alias("us"), F.current_timestamp().alias("arrived"))
    out = T.StructType([T.StructField("id", stream.schema[key].dataType), T.StructField("us", T.LongType())])
    found = rows.withWatermark("arrived", "0 seconds").groupBy("id").transformWithStateInPandas(Lowest(keep_ms), out, "Append", "EventTime")
    progress = land(found, path, lambda df: df)
    if seen is not None:
        seen += progress
    return landed(spark, path).groupBy(F.col("id").alias(key)).agg(F.timestamp_micros(F.min("us")).alias("first"))


def deduplicated(stream: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """One row for each of ``keys``, however far apart its copies come: the least of its rows in the order of columns.

    A batch lands one row a key; state isn't needed for that, and the reader's merge takes out what later batches repeat.
    """
    spark, path = stream.sparkSession, path or scratch_path(stream.sparkSession, "dedup")
    rest = [c for c in stream.columns if c not in keys]

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])

    land(stream, path, least)
    return least(landed(spark, path))


# ---------------------------------------------------------------- joins of two streams


def late_actuals(preds: DataFrame, actuals: DataFrame, key: str, pred_t: str, actual_t: str, days: int, path: str | None = None) -> DataFrame:
    """Predictions with every actual of their key within ``days`` after them, and those without any; whatever the order in which rows came.

    A batch of either stream is joined with all that the other one has landed before, in the days that it can match, and then lands itself by
    day.  Every pair meets when the later of the two comes, once.  No state is kept; the landed rows are the history.
    """
    spark, path = preds.sparkSession, path or scratch_path(preds.sparkSession, "late")
    sides = {"p": (preds, pred_t), "a": (actuals, actual_t)}
    both = None
    for side, (df, t) in sides.items():
        x = df.select(F.lit(side).alias("side"), F.col(key).alias("_key"), F.col(t).alias("_t"), F.struct(*df.columns).alias(side))
        both = x if both is None else both.unionByName(x, allowMissingColumns=True)

    def match(p: DataFrame, a: DataFrame) -> DataFrame:
        p, a = p.select("_key", F.col("_t").alias("_pt"), "p"), a.select(F.col("_key").alias("_ak"), F.col("_t").alias("_at"), "a")
        ok = (F.col("_key") == F.col("_ak")) & (F.col("_at") >= F.col("_pt")) & (F.col("_at") <= F.col("_pt") + F.make_dt_interval(F.lit(days)))
        return p.join(a, ok).select("p", "a")

    def write(df: DataFrame, number: int) -> None:
        new = f"{path}/rows/batch={number}"
        df.withColumn("day", F.to_date("_t")).write.mode("overwrite").partitionBy("side", "day").parquet(new)
        now = spark.read.schema(both.schema).parquet(new)
        before = _history(spark, path, both.schema, number)
        span = now.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).first()
        pairs = match(now.where("side = 'p'"), now.where("side = 'a'"))
        if before is not None and span.lo is not None:
            near = before.where(F.col("day").between(F.date_sub(F.lit(span.lo), days + 1), F.date_add(F.lit(span.hi), days + 1)))
            pairs = pairs.unionByName(match(now.where("side = 'p'"), near.where("side = 'a'"))).unionByName(match(near.where("side = 'p'"), now.where("side = 'a'")))
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")

    both.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "stream-state")).foreachBatch(write).start().awaitTermination()
    pairs = spark.read.parquet(f"{path}/pairs")
    every = spark.read.parquet(f"{path}/rows").where("side = 'p'").select("p")
    alone = every.join(pairs.select(F.col("p").alias("_m")).distinct(), F.col("p").eqNullSafe(F.col("_m")), "left_anti").withColumn("a", F.lit(None).cast(pairs.schema["a"].dataType))
    out = pairs.select("p", "a").unionByName(alone)
    return out.select("p.*", *[F.col(f"a.{c}").alias(c) for c in actuals.columns if c != key])


def _history(spark: SparkSession, path: str, schema, number: int) -> DataFrame | None:
    """What the batches before ``number`` landed, by day."""
    if number == 0:
        return None
    found = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return found.where(F.col("batch") < number)
