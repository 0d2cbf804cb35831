"""Medians among neighbours, against all pairs, and what is written for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models as M, neighbours as N


def rows(n=240, seed=5):
    """Rows in two groups and a NULL one with equal positions, equal prices, and some without a place or price."""
    rng = np.random.default_rng(seed)
    out = [(f"{i % 2}" if i % 13 else None, float(rng.integers(-6, 7)), float(rng.integers(-4, 5)) + 0.5 * (i % 3), float(rng.integers(1, 30))) for i in range(n)]
    return out + out[:9] + [("0", None, 1.0, 5.0), ("0", float("nan"), 1.0, 5.0), ("1", 1.0, 1.0, None), ("9", 0.0, 0.0, 4.0)]


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("chunk", [20_000, 7])
def test_middles_are_those_of_all_pairs(spark, metric, chunk):
    data = rows()
    spots = spark.createDataFrame(data, "g string, x double, y double, p double").groupBy("g", "x", "y", "p").agg(F.count(F.lit(1)).alias("k"))
    got = N.middle_within(spots, ["g"], ["x", "y"], 2.5, "p", "k", metric, chunk).collect()
    there = [r for r in data if None not in r[1:] and not np.isnan(r[1])]
    assert len(got) == len(set(there)) and sum(r.k for r in got) == len(there)
    for r in got:
        gaps = [(abs(r.x - x), abs(r.y - y), p) for g, x, y, p in there if g == r.g]
        near = sorted(p for a, b, p in gaps if (a + b if metric == "l1" else np.hypot(a, b)) <= 2.5)
        near.remove(r.p)
        n = len(near)
        assert (r.n, r.lo, r.hi, r.a, r.b) == ((n, near[0], near[-1], near[(n - 1) // 2], near[n // 2]) if n else (0, None, None, None, None))


def test_a_dense_place_writes_no_list_of_its_prices(spark, monkeypatch):
    """900 places, each within reach of all others, with a price of its own."""
    written = []

    def counted(df, write=N.materialize):
        out = write(df)
        written.append(out.count())
        return out

    for module in (M, N):
        monkeypatch.setattr(module, "materialize", counted)
    df = spark.range(900).selectExpr("id", "'a' as g", "id / 900 as x", "double(id % 7) / 7 as y", "double(id + 1) as price")
    got = {r.id: r for r in M.price_vicinity(df, "id", ["g"], ["x", "y"], 8.0).collect()}
    assert len(got) == 900 and all(got[i].ratio_median == pytest.approx((i + 1) / (450 if i >= 450 else 451)) for i in range(900))
    assert got[0].price_range == 898.0 and got[899].is_highest == 1 and got[0].is_lowest == 1 and got[5].is_highest == 0
    assert sum(written) < 20 * 900
