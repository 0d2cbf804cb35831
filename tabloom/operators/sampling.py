"""Sampling, partitioning and weights.  Every random choice is a seeded hash of the row's key, so a
recomputed task repeats it, and nothing is sorted globally unless an exact size is asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.operators.order import (
    group_transform, hash_order, hash_unit, null_safe_join, quantile_list, row_positions,
)
from tabloom.session import materialize, small_side
from tabloom.spec import SeriesSpec


def series_means(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row for each series, written once: what cuts and ranks them reads them several times."""
    return materialize(df.groupBy(spec.series_id).agg(F.avg(spec.target).alias("_mean")))


def _first(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows along ``order``: by position over slices, so that no task holds them all."""
    return row_positions(df, order, name="_at").filter(F.col("_at") <= n).drop("_at")


def top_series(df: DataFrame, spec: SeriesSpec, n: int, top: bool = True) -> DataFrame:
    """Rows of the ``n`` series with the largest (smallest) mean target; ties by series id."""
    return df.join(small_side(_first(series_means(df, spec).withColumn("_by", -F.col("_mean") if top else F.col("_mean")), ["_by", spec.series_id], n)), spec.series_id, "left_semi")


def series_by_quantile(df: DataFrame, spec: SeriesSpec, q: float, top: bool = True) -> DataFrame:
    """Rows of series whose mean target is at or beyond the ``q`` quantile of the series means."""
    m = series_means(df, spec)
    edge = quantile_list(m, "_mean", [q])[0]
    return df.join(m.filter(F.col("_mean") >= edge if top else F.col("_mean") <= edge), spec.series_id, "left_semi")


def sample_fraction(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    return df.filter(hash_unit(*key, seed=seed) < fraction)


def sample_exact(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows: the first in hash order."""
    return _first(df.withColumn("_hash", hash_order(*key, seed=seed)), ["_hash", *key], n).drop("_hash")


def sample_series(df: DataFrame, spec: SeriesSpec, share: float, method: str = "random", seed: int = 0) -> DataFrame:
    """Rows of ``share`` of the series: at random, of largest mean, or of longest time span."""
    s, d = spec.series_id, spec.date_col
    t = materialize(df.groupBy(s).agg(F.avg(spec.target).alias("target"), (F.max(F.unix_micros(d)) - F.min(F.unix_micros(d))).alias("timespan")))
    n = int(t.count() * share)
    key = {"random": hash_order(s, seed=seed), "target": -F.col("target"), "timespan": -F.col("timespan")}[method]
    return df.join(_first(t.withColumn("_by", key), ["_by", s], n).select(s), s, "left_semi")


def sample_groups(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` randomly chosen groups."""
    chosen = _first(df.select(group).distinct().withColumn("_hash", hash_order(group, seed=seed)), ["_hash", group], n)
    return df.join(chosen, group, "left_semi")


def stratified_partition(df: DataFrame, target: str, key: Sequence[str], folds: int, holdout: float, seed: int = 0) -> DataFrame:
    """Column ``partition``: a holdout share ``H`` and ``T1..Tk``, balanced within each target class.

    Position in hash order within the class comes from sliced running counts, so one huge class is
    not sorted in one task.
    """
    h = df.withColumn("_h", hash_order(*key, seed=seed))
    p = row_positions(h, ["_h", *key], [target], "_pos")
    p = group_transform(p, [target], {"_n": F.count(F.lit(1))})
    held = F.floor(F.col("_n") * holdout + 0.5)
    fold = F.concat(F.lit("T"), (F.col("_pos") - held - 1) % folds + 1)
    return p.withColumn("partition", F.when(F.col("_pos") <= held, "H").otherwise(fold)).drop("_h", "_pos", "_n")


def group_split(df: DataFrame, keys: Sequence[str], frac: float, seed: int = 0) -> DataFrame:
    """``split`` = train or test by the hash of the keys, so no key is on both sides; no shuffle."""
    return df.withColumn("split", F.when(hash_unit(*keys, seed=seed) < frac, "train").otherwise("test"))


def time_split(df: DataFrame, spec: SeriesSpec, share: float = 0.1, season: int = 1) -> DataFrame:
    """``part``: the last ``share`` of each series is holdout, the ``share`` before it valid, both
    rounded to whole seasons (at least one)."""
    p = row_positions(df, [spec.date_col], [spec.series_id], "_pos")
    p = group_transform(p, [spec.series_id], {"_n": F.count(F.lit(1))})
    size = F.greatest(F.lit(1), F.round(F.col("_n") * share / season)) * season
    left = F.col("_n") - F.col("_pos")
    return p.withColumn("part", F.when(left < size, "holdout").when(left < 2 * size, "valid").otherwise("train")).drop("_pos", "_n")


def year_split(df: DataFrame, date_col: str, valid: int, holdout: int) -> DataFrame:
    """``part`` by calendar year: holdout from the year ``holdout`` on, valid from ``valid`` on, train before; NULL dates have none."""
    year = F.year(date_col)
    return df.withColumn("part", F.when(year >= holdout, "holdout").when(year >= valid, "valid").when(year < valid, "train"))


def block_partition(df: DataFrame, order: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """Repeating assignment of labels along an explicit order."""
    p = row_positions(df, order, name="_pos")
    labels = F.array(*[F.lit(b) for b in blocks])
    return p.withColumn("partition", F.get(labels, ((F.col("_pos") - 1) % len(blocks)).cast("int"))).drop("_pos")


def downsample_majority(df: DataFrame, target: str, majority, key: Sequence[str], rate: float, seed: int = 0, normalise: bool = False, draw: Column | None = None) -> DataFrame:
    """Keep ``rate`` of the majority class with weight 1/rate, all others with weight 1.

    With ``normalise`` both weights are multiplied by the share of rows that are kept, so that they add up to about the number of these.
    ``draw`` gives each row's number in [0, 1); by default it is a hash of the key.
    """
    big = F.col(target) == majority
    u = hash_unit(*key, seed=seed) if draw is None else draw
    kept = df.filter(~big | (u < rate)).withColumn("weight", F.when(big, 1.0 / rate).otherwise(1.0))
    if not normalise:
        return kept
    share = df.agg((F.count_if(F.coalesce(~big | (u < rate), F.lit(False))) / F.count(F.lit(1))).alias("_share"))
    return kept.crossJoin(F.broadcast(share)).withColumn("weight", F.col("weight") * F.col("_share")).drop("_share")


def reweight_to_mean(df: DataFrame, target: str, mean: float) -> DataFrame:
    """Weight of the positives such that the weighted mean of a 0/1 target equals ``mean``."""
    c = df.agg(F.sum(target).alias("_pos"), F.count(target).alias("_all"))
    w = mean * (F.col("_all") - F.col("_pos")) / ((1 - mean) * F.col("_pos"))
    return df.crossJoin(F.broadcast(c)).withColumn("weight", F.when(F.col(target) == 1, w).otherwise(1.0)).drop("_pos", "_all")


def shuffle(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(*key, seed=seed), *key)


#: Cumulative probabilities of 0, 1, ... copies, to the end of double precision.
POISSON_CUTS = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(19))


def poisson_copies(u: Column) -> Column:
    """Poisson(1) count from a uniform number, by its cumulative probabilities."""
    out = F.lit(len(POISSON_CUTS))
    for k in range(len(POISSON_CUTS) - 1, -1, -1):
        out = F.when(u < POISSON_CUTS[k], k).otherwise(out)
    return out


def bootstrap(df: DataFrame, key: Sequence[str], replicates: int = 1, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Bootstrap replicates as weights: columns ``replicate`` and ``copies`` (> 0), rows not repeated.

    ``draw`` gives the number in [0, 1) of a row and ``replicate``; by default it is a hash of both.
    """
    r = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return r.withColumn("copies", poisson_copies(hash_unit(*key, "replicate", seed=seed) if draw is None else draw)).filter("copies > 0")


def chunk_ids(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """Chunk number of ``rows`` consecutive rows along an explicit order."""
    return row_positions(df, order, name="_pos").withColumn("chunk", F.floor((F.col("_pos") - 1) / rows)).drop("_pos")


def sample_to_size(df: DataFrame, key: Sequence[str], target_bytes: int, probe: float = 0.01, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """About ``target_bytes`` of rows: bytes per row are measured on a probe, the rate is then a filter on a hash of the key, or on ``draw`` in [0, 1)."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    p = sample_fraction(df, key, probe, seed + 1).agg(F.avg(size).alias("b"), F.count(F.lit(1)).alias("k")).first()
    if not p["k"]:
        p = df.agg(F.avg(size).alias("b")).first()
        if p["b"] is None:
            return df
    rate = min(1.0, target_bytes / (p["b"] * df.count()))
    return sample_fraction(df, key, rate, seed) if draw is None else df.filter(draw < rate)
