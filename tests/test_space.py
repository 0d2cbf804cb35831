"""Interval nodes and the tree of cells against brute force, and how their work grows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabloom.operators import joins as J, neighbours as N


def nodes_of(low, high):
    """The nodes of an interval, from the formula of ``dyadic``."""
    out = []
    for k in range(min(61, math.ceil(math.log2(high - low + 2))) + 1):
        a, b = -((-low) >> k), (high + 1) >> k
        if a < b and a % 2:
            out.append((k, a))
        if a < b and b % 2:
            out.append((k, b - 1))
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(-5000, 5000), st.integers(0, 3000))
def test_nodes_cover_an_interval_once(low, width):
    high = low + width
    covered = sorted(x for k, at in nodes_of(low, high) for x in range(at << k, (at + 1) << k))
    assert covered == list(range(low, high + 1))


def test_dyadic_is_the_formula_and_short(spark):
    ten_years = 10 * 366 * 86400
    rows = [(0, ten_years), (-7, 12), (5, 5), (5, 4), (1_700_000_001, 1_700_000_001 + ten_years), (-(2**40) + 1, 2**40 - 1), (None, 3)]
    got = spark.createDataFrame(rows, "low long, high long").select("low", "high", J.dyadic(F.col("low"), F.col("high")).alias("x")).collect()
    for r in got:
        if r.low is None or r.low > r.high:
            assert r.x is None
        else:
            assert sorted((n.lev, n.at) for n in r.x) == sorted(nodes_of(r.low, r.high))
            assert len(r.x) <= 2 * math.log2(r.high - r.low + 2) + 2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, how):
    rng = np.random.default_rng(1)
    low = rng.integers(0, 10**6, 80)
    right = [(int(i), int(a), int(a + rng.choice([0, 10, 1000, 900_000]))) for i, a in enumerate(low)] + [(98, None, 5), (99, 9, 3)]
    left = [(int(i), int(p)) for i, p in enumerate(rng.integers(-1000, 2 * 10**6, 60))] + [(60, None), (61, int(low[0]))]
    cast = "timestamp_seconds({0})"
    l = spark.createDataFrame(left, "id long, p long").selectExpr("id", cast.format("p") + " as p")
    r = spark.createDataFrame(right, "k long, low long, high long").selectExpr("k", cast.format("low") + " as low", cast.format("high") + " as high")
    got = sorted((x.id, -1 if x.k is None else x.k) for x in J.range_join(l, "p", r, "low", "high", how).collect())
    want = [(i, k) for i, p in left for k, a, b in right if None not in (p, a) and a <= p <= b]
    if how == "left":
        want += [(i, -1) for i, _ in left if i not in {x for x, _ in want}]
    assert got == sorted(want)


def brute(rows, radii, dist):
    return sorted((x[0], r, sum(dist(x, y) <= r for y in rows if y[1] == x[1]) - 1) for x in rows for r in radii)


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_radius_counts_where_cells_are_dense(spark, metric):
    rng = np.random.default_rng(2)
    dense = rng.normal(0, 0.05, (150, 2)).round(3)
    ring = rng.uniform(-4, 4, (150, 2)).round(2)
    pts = np.vstack([dense, ring, ring[:5]])
    rows = [(i, None if i % 17 == 0 else "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    f = (lambda a, b: abs(a[2] - b[2]) + abs(a[3] - b[3])) if metric == "l1" else (lambda a, b: math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2))
    radii = [0.5, 1.0, 3.0]
    here = df.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("k"))
    near = N.within(here, ["g"], ["x", "y"], radii, {"k": F.sum}, metric=metric, leaf=4)
    got = {(r.g, r.x, r.y, r.r): r.k for r in near.collect()}
    want = brute(rows, radii, f)
    assert all(got[(rows[i][1], rows[i][2], rows[i][3], r)] - 1 == n for i, r, n in want)


def test_nearest_other(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 0.01, (120, 3)), rng.normal(40, 0.01, (60, 3)), rng.uniform(-100, 100, (40, 3))]).round(4)
    rows = [(int(i % 3), *map(float, p)) for i, p in enumerate(pts)] + [(0, *map(float, pts[0])), (7, 1.0, 1.0, 1.0), (None, 0.0, 0.0, 0.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g long, x double, y double, z double")
    for metric, f in (("l1", lambda d: np.abs(d).sum()), ("l2", lambda d: math.sqrt((d**2).sum()))):
        got = {(r.g, r.x, r.y, r.z): r.nearest for r in N.nearest_other(df, ["g"], ["x", "y", "z"], metric, leaf=4).collect()}
        for a in set(rows):
            ds = [f(np.array(a[1:]) - np.array(b[1:])) for b in rows if b[0] == a[0] and b != a]
            assert got.get(a) == pytest.approx(min(ds)) if ds else a not in got


def test_a_dense_cell_grows_linearly(spark, monkeypatch):
    """Pairs that are formed when all of a cell lies within the radius: in proportion to its positions."""
    formed = []
    real = N.null_safe_join

    def counted(left, right, keys, how="inner"):
        out = real(left, right, keys, how)
        formed.append(out.count())
        return out

    monkeypatch.setattr(N, "null_safe_join", counted)
    sizes = []
    for n in (1000, 4000):
        formed.clear()
        pts = np.random.default_rng(4).normal(0.5, 0.001, (n, 2))
        df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double").withColumns({"g": F.lit(1), "k": F.lit(1)})
        out = N.within(df, ["g"], ["x", "y"], [1.0, 2.0], {"k": F.sum})
        assert {(r.r, r.k) for r in out.select("r", "k").distinct().collect()} == {(1.0, n), (2.0, n)}
        sizes.append(sum(formed))
    assert sizes[1] < 8 * sizes[0] and sizes[1] < 4000 * 100
