"""Structured Streaming jobs.  Each shares its expressions with a batch operator, so the same function
accepts a streaming or a static DataFrame; only the sinks below start a query.

These forms follow Spark's watermark: a row that comes later than its delay is left out.  ``keyed.py`` has forms that keep every row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.operators.order import quantile_list
from tabloom.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None, names: str | None = None) -> DataFrame:
    """New files of a folder as a stream; ``names`` is a pattern for file names."""
    r = spark.readStream.schema(schema).format(fmt)
    r = r.option("pathGlobFilter", names) if names else r
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


# ---------------------------------------------------------------- transformations


def service_stats(df: DataFrame, t: str, keys: Sequence[str], value: str, window: str = "12 hours", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Requests, mean and largest response time per key and tumbling or sliding window of event time."""
    w = F.window(t, window, slide) if slide else F.window(t, window)
    g = df.withWatermark(t, delay).groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")
    )
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean_value", "max_value")


def session_stats(df: DataFrame, t: str, keys: Sequence[str], value: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = df.withWatermark(t, delay).groupBy(F.session_window(t, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def expanding_stats(df: DataFrame, t: str, keys: Sequence[str], value: str, window: str = "12 hours") -> DataFrame:
    """Batch form over all history: counts and mean up to the end of each interval."""
    from tabloom.operators.order import prefix_sum

    x = df.withColumn("start", F.window(t, window).start)
    p = prefix_sum(x, "start", {"n": F.lit(1), "s": F.col(value)}, keys)
    return p.select(*keys, "start", F.col("cum_n").alias("n"), (F.col("cum_s") / F.col("cum_n")).alias("mean_value"))


def late_actuals_join(preds: DataFrame, actuals: DataFrame, key: str, pred_t: str, actual_t: str, max_delay: str, watermark: str = "1 hour", how: str = "leftOuter") -> DataFrame:
    """Actuals that arrive after their prediction, within ``max_delay``; later ones are dropped.

    Both sides carry a watermark, so the state of a prediction ends when its time is over.  As a stream this needs both sides in the order of
    time, but for the watermark; :func:`keyed.late_actuals` doesn't.
    """
    p = preds.withWatermark(pred_t, watermark)
    a = actuals.withColumnRenamed(key, "_akey").withWatermark(actual_t, watermark)
    cond = (F.col(key) == F.col("_akey")) & (F.col(actual_t) >= F.col(pred_t)) & (F.col(actual_t) <= F.col(pred_t) + F.expr(f"interval {max_delay}"))
    return p.join(a, cond, how).drop("_akey")


def rolling_accuracy(joined: DataFrame, t: str, metric: Column, window: str, baseline: float, delay: str = "1 hour") -> DataFrame:
    """Metric per window with the baseline and the relative change in percent."""
    g = joined.withWatermark(t, delay).groupBy(F.window(t, window).alias("w")).agg(metric.alias("value"), F.count(F.lit(1)).alias("n"))
    return g.select(
        F.col("w.start").alias("start"), "n", "value", F.lit(baseline).alias("baseline"), (100 * F.try_divide(F.col("value") - baseline, F.lit(baseline))).alias("pct_change")
    )


def reference_bins(ref: DataFrame, col: str, bins: int = 10) -> tuple[list[float], list[float]]:
    """Inner quantile edges of the reference and the reference share of each bin."""
    edges = sorted(set(quantile_list(ref, col, [i / bins for i in range(1, bins)])))
    b = bin_of(F.col(col), edges)
    rows = {r["b"]: r["n"] for r in ref.filter(F.col(col).isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(rows.values())
    return edges, [rows.get(i, 0) / total for i in range(len(edges) + 1)]


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    return sum([(c > e).cast("int") for e in edges], F.lit(0))


def drift(df: DataFrame, t: str, col: str, edges: Sequence[float], shares: Sequence[float], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Population stability index per window against the reference bins.

    Empty shares are floored at 1e-6.  One aggregation: bin counts are conditional counts.
    """
    b = bin_of(F.col(col), edges)
    k = len(shares)
    g = df.filter(F.col(col).isNotNull()).withWatermark(t, delay).groupBy(F.window(t, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(b == i) for i in range(k)]).alias("c")
    )
    psi = F.lit(0.0)
    for i in range(k):
        a = F.greatest(F.get("c", F.lit(i)) / F.col("n"), F.lit(1e-6))
        e = F.lit(max(float(shares[i]), 1e-6))
        psi = psi + (a - e) * F.ln(a / e)
    return g.select(F.col("w.start").alias("start"), "n", psi.alias("psi"))


def first_seen(df: DataFrame, key: str, t: str) -> DataFrame:
    """First time per key; as a stream this is a minimum kept in state (update or complete mode)."""
    return df.groupBy(key).agg(F.min(t).alias("first"))


def dedup(df: DataFrame, keys: Sequence[str], t: str, delay: str = "1 hour") -> DataFrame:
    """One row per key; as a stream, among rows no further apart than the watermark delay."""
    if df.isStreaming:
        return df.withWatermark(t, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


# ---------------------------------------------------------------- sinks


def run_to_table(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append", partition_by: Sequence[str] = (), batch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process everything available, then stop.

    ``append`` uses the exactly-once file sink.  ``complete`` replaces the (small) result table in
    every batch: a batch that is repeated after a failure writes the same rows again.
    """
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "stream-state"))
    if mode == "append":
        w = w.outputMode("append").format("parquet").option("path", path)
        if partition_by:
            w = w.partitionBy(*partition_by)
    else:

        def replace(df: DataFrame, _: int) -> None:
            (batch(df) if batch else df).write.mode("overwrite").parquet(path)

        w = w.outputMode(mode).foreachBatch(replace)
    q = w.start()
    q.awaitTermination()


def daily_incremental(spark: SparkSession, source: str, schema, target: str, t: str, state: str, fmt: str = "parquet") -> None:
    """One scheduled run: files that arrived since the last run are appended, partitioned by day.

    ``state`` is the checkpoint folder that remembers which files are done.
    """
    s = file_stream(spark, source, schema, fmt).withColumn("day", F.to_date(t))
    q = (
        s.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode("append")
        .format("parquet").option("path", target).partitionBy("day").start()
    )
    q.awaitTermination()


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], spark: SparkSession, path: str) -> None:
    """Rows scored inside the streaming plan and appended."""
    run_to_table(scorer(stream), spark, path)
