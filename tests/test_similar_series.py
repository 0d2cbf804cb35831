"""Partial autocorrelations from sums, clusters on distances, and largest inner products, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models as M, series as T
from tabloom.spec import SeriesSpec

SPEC = SeriesSpec("s", "d", "y")


def frame(spark, values):
    rows = [(s, i, None if v is None else float(v)) for s, x in values.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "s string, i int, y double").select("s", F.timestamp_seconds(F.col("i") * 86400).alias("d"), "y")


def ols(x, k):
    x = x - x.mean()
    lags = np.column_stack([np.ones(len(x) - k), *[x[k - i : len(x) - i] for i in range(1, k + 1)]])
    return np.linalg.lstsq(lags, x[k:], rcond=None)[0][-1]


def levinson(x, n):
    x = x - x.mean()
    r = np.array([(x[i:] * x[: len(x) - i]).sum() for i in range(n + 1)])
    return [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1 : k + 1])[-1] for k in range(1, n + 1)]


def test_pacf_is_numpys(spark):
    rng = np.random.default_rng(0)
    ar = np.zeros(300)
    for i in range(2, 300):
        ar[i] = 0.6 * ar[i - 1] - 0.3 * ar[i - 2] + rng.normal()
    values = {"ar": ar + 50, "noise": rng.normal(size=40), "short": [1.0, 3.0, 2.0, 5.0, 4.0], "flat": [2.0] * 9, "holes": [None, *ar[:60], None]}
    for method, want in (("ols", ols), ("levinson", None)):
        got = {r.s: r for r in T.pacf_features(frame(spark, values), SPEC, 4, alpha=None, method=method).collect()}
        for s, v in values.items():
            x = np.array([a for a in v if a is not None], float)
            for k in range(1, 5):
                p = got[s][f"pacf_{k}"]
                if s == "flat" or k > (len(x) - 1) // 2:
                    assert np.isnan(p)
                else:
                    assert p == pytest.approx(ols(x, k) if want else levinson(x, 4)[k - 1], abs=1e-7)


def test_planted_groups_are_found(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 60))
    values = {f"g{i % 3}_{i}": base[i % 3] * (1 + i) + 0.2 * rng.normal(size=60) + i for i in range(24)} | {"flat": np.ones(60)}
    df = frame(spark, values)
    for landmarks in (256, 12):
        got = T.distance_clusters(df, SPEC, landmarks=landmarks, max_k=5)
        rows = {r.s: r for r in got.collect()}
        assert len(rows) == 25
        labels = [{rows[s].cluster for s in values if s.startswith(f"g{i}")} for i in range(3)]
        assert all(len(x) == 1 for x in labels) and len(set.union(*labels)) == 3
        assert all(rows[r.medoid].medoid == r.medoid for r in rows.values())


def test_top_products(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(80, 6)), rng.normal(size=(700, 6)) * rng.exponential(size=(700, 1))
    v[5] = v[6]
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "id int, features array<float>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, features array<float>")
    found, skipped = M.top_products(users, items, block=50)
    p = u.astype("float32").astype(float) @ v.astype("float32").astype(float).T
    assert {r.user: r.score for r in found.collect()} == pytest.approx({i: x.max() for i, x in enumerate(p)}, rel=1e-9)
    assert {r.user: r.item for r in found.collect()} == {i: int(x.argmax()) for i, x in enumerate(p)} and skipped > 0.3
    assert M.top_products(users, items.limit(0))[0].count() == 80
