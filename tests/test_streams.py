"""Streams in files that follow no order of time, one a micro-batch, against the same work on the whole table."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.order import null_safe_join
from tabloom.streaming import jobs as J, keyed as K


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """400 events of 20 days in six shuffled files, some keys and times NULL, and the folder with them."""
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 50 == 0 else f"u{rng.integers(0, 12)}", start + dt.timedelta(seconds=int(rng.integers(0, 20 * 86400))), float(rng.integers(0, 9)), "pa"[int(rng.random() < 0.4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp, v double, kind string")
    path = str(tmp_path_factory.mktemp("events") / "files")
    df.repartition(6, "id").write.parquet(path)
    return df, path


def stream(spark, events):
    return J.file_stream(spark, events[1], events[0].schema, max_files=1)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_windows(spark, events):
    got = K.window_stats(stream(spark, events), "t", ["k"], K.service("v"), "12 hours", "6 hours")
    w = F.window("t", "12 hours", "6 hours")
    want = events[0].groupBy(w.alias("w"), "k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value"), F.max("v").alias("max_value"))
    same(got, want.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "k", "n", "mean_value", "max_value"))


def test_sessions(spark, events):
    got = K.session_stats(stream(spark, events), "t", ["k"], "v", "10 hours")
    g = events[0].groupBy(F.session_window("t", "10 hours").alias("w"), "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    same(got, g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "k", "n", "total"))


def test_first_seen_with_little_state(spark, events):
    want = events[0].groupBy("k").agg(F.min("t").alias("first"))
    for keep in (86_400_000, 1):
        seen: list = []
        same(K.first_seen(stream(spark, events), "k", "t", keep, seen=seen), want)
        rows = [s["numRowsTotal"] for p in seen for s in p["stateOperators"]]
        assert rows and max(rows) <= 4 * 13  # a value and a timer a key, and their indexes; 400 rows went by
        assert keep > 1 or rows[-1] < max(rows)  # forgotten again


def test_late_actuals(spark, events):
    s = stream(spark, events)
    preds = lambda df: df.where("kind = 'p'").select("id", "k", F.col("t").alias("pt"))
    acts = lambda df: df.where("kind = 'a'").select("k", F.col("t").alias("at"), "v")
    got = K.late_actuals(preds(s), acts(s), "k", "pt", "at", 2)
    p, a = preds(events[0]), acts(events[0])
    want = p.join(a, (p["k"] == a["k"]) & a["at"].between(p["pt"], p["pt"] + F.expr("interval 2 days")), "left").select(p["id"], p["k"], "pt", "at", "v")
    same(got, want)


def test_one_row_a_key(spark, events):
    got = K.deduplicated(stream(spark, events).select("k", "kind", "id"), ["k", "kind"])
    same(got, events[0].groupBy("k", "kind").agg(F.min("id").alias("id")))


def test_drift_of_many_columns_is_that_of_each(spark, events):
    df = events[0].withColumn("x", F.col("id") % 7)
    ref = df.where("id < 100")
    bins = {c: J.reference_bins(ref, c, 4) for c in ("v", "x")}
    live = stream(spark, events).withColumn("x", F.col("id") % 7)
    got = {(r.feature, r.start): (r.n, r.psi) for r in K.drift_many(live, "t", {c: e for c, (e, _) in bins.items()}, {c: s for c, (_, s) in bins.items()}).collect()}
    for c, (edges, shares) in bins.items():
        each = {(c, r.start): (r.n, r.psi) for r in J.drift(df, "t", c, edges, shares).collect()}
        assert {k: v for k, v in got.items() if k[0] == c} == {k: (n, pytest.approx(p)) for k, (n, p) in each.items()}


def test_a_side_without_keys_has_one_row(spark):
    two = spark.range(2)
    assert null_safe_join(two, two.agg(F.max("id").alias("m")), []).count() == 2
    with pytest.raises(Exception, match="several rows"):
        null_safe_join(two, two.withColumnRenamed("id", "b"), []).collect()
