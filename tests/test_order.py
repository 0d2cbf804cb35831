"""Ordered primitives against pandas on a table whose largest key holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import joins as J, order as O, ranking as R, windows as W


def table(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("slices", [1, 5, 64])
@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sum(skewed, slices, by, descending):
    df, pdf = skewed
    got = O.prefix_sum(df, "t", {"s": F.col("v"), "n": F.lit(1)}, by, descending, slices).toPandas()
    g = pdf.groupby([*by, "t"], as_index=False).agg(s=("v", lambda x: x.sum(min_count=1)), n=("id", "size"))
    g = g.sort_values("t", ascending=not descending)
    grp = g.groupby(by) if by else g.groupby(lambda _: 0)
    g["cum_n"] = grp["n"].cumsum()
    g["cum_s"] = g.assign(s=g.s.fillna(0)).groupby(by if by else (lambda _: 0))["s"].cumsum()
    m = got.merge(g, on=[*by, "t"], suffixes=("", "_w"))
    assert len(m) == len(got) == len(g)
    assert (m.cum_n == m.cum_n_w).all() and np.allclose(m.cum_s, m.cum_s_w)


@pytest.mark.parametrize("slices", [1, 16])
def test_row_positions_and_ranks(skewed, slices):
    df, pdf = skewed
    got = O.row_positions(df, ["t", "id"], ["k"], slices=slices).toPandas().set_index("id").pos
    want = pdf.sort_values(["t", "id"]).assign(pos=lambda d: d.groupby("k").cumcount() + 1).set_index("id").pos
    assert (got.sort_index() == want.sort_index()).all()
    r = O.ranks(df, "t", ["k"], slices=slices).toPandas().set_index("id").sort_index()
    by = pdf.set_index("id").groupby("k").t
    for name, how in (("rank_min", "min"), ("rank_max", "max"), ("rank_avg", "average"), ("rank_dense", "dense")):
        assert np.allclose(r[name], by.rank(method=how).sort_index())


@pytest.mark.parametrize("forward", [False, True])
def test_carry_last(skewed, forward):
    df, pdf = skewed
    got = O.carry_last(df, ["t", "id"], ["v"], ["k"], forward, slices=16).toPandas().set_index("id").last_v.sort_index()
    s = pdf.sort_values(["t", "id"]).set_index("id")
    want = (s.groupby("k").v.bfill() if forward else s.groupby("k").v.ffill()).sort_index()
    assert got.fillna(-99).equals(want.fillna(-99))


def test_windowed_chunks_equal_plain_window(skewed):
    df, _ = skewed

    def build(w):
        return {"lag": F.lag("v", 3).over(w), "lead": F.lead("v", 2).over(w), "s": F.sum("v").over(w.rowsBetween(-4, 1))}

    cols = ["id", "lag", "lead", "s"]
    plain = O.windowed(df, ["k"], ["t", "id"], build, 4, 2)
    cut = O.windowed(df, ["k"], ["t", "id"], build, 4, 2, rows_per_task=6)
    assert table(plain, cols) == table(cut, cols)


def test_rolling_mode_and_last_k_in_chunks(skewed):
    df, pdf = skewed
    a = W.rolling_mode(df.fillna(0.0), ["k"], ["t", "id"], "v", 5)
    b = W.rolling_mode(df.fillna(0.0), ["k"], ["t", "id"], "v", 5, rows_per_task=6)
    assert table(a, ["id", "mode"]) == table(b, ["id", "mode"])
    s = pdf.fillna({"v": 0.0}).sort_values(["t", "id"])
    want = s.groupby("k").v.transform(lambda x: x.rolling(5, min_periods=1).apply(lambda w: pd.Series(w).mode().min()))
    got = a.toPandas().set_index("id")["mode"].sort_index()
    assert np.allclose(got, want.set_axis(s.id).sort_index())
    item = df.withColumn("item", (F.col("id") % 7).cast("string"))
    x = W.last_k_items(item, ["k"], "t", "item", 4)
    y = W.last_k_items(item, ["k"], "t", "item", 4, rows_per_task=5)
    assert table(x, x.columns) == table(y, x.columns)


def test_quantiles_and_bins(skewed):
    df, pdf = skewed
    got = O.quantiles(df, "v", [0.0, 0.1, 0.5, 0.93, 1.0], ["k"], slices=16).toPandas().set_index("k")
    want = pdf.groupby("k").v.quantile([0.0, 0.1, 0.5, 0.93, 1.0]).unstack()
    assert np.allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy())
    q = O.qcut(df, "t", 4).toPandas().set_index("id").bin.sort_index()
    assert (q == pd.qcut(pdf.t, 4, labels=False) + 1).all()
    c = O.cut(df, "t", 5).toPandas().set_index("id").bin.sort_index()
    assert (c == pd.cut(pdf.t, 5, labels=False) + 1).all()
    with pytest.raises(ValueError):
        O.qcut(df, "v", 50)


def test_weighted_percentile_with_unit_weights_is_between_neighbours(skewed):
    df, _ = skewed
    p = O.weighted_percentile(df.withColumn("w", F.lit(1.0)), "t", "w", 0.5).first()[0]
    assert 0 <= p <= 90


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_join(skewed, direction, exact):
    df, pdf = skewed
    left, right = df.filter("id % 3 <> 0").select("id", "k", "t"), df.filter("id % 3 = 0").groupBy("k", "t").agg(F.max("id").alias("rid"))
    got = J.asof_join(left, right, ["k"], "t", direction, exact).toPandas().set_index("id").rid.sort_index()
    lp = pdf[pdf.id % 3 != 0].sort_values(["t", "id"])
    rp = pdf[pdf.id % 3 == 0].groupby(["k", "t"], as_index=False).id.max().rename(columns={"id": "rid"}).sort_values("t")
    want = pd.merge_asof(lp, rp, on="t", by="k", direction=direction, allow_exact_matches=exact).set_index("id").rid.sort_index()
    assert got.fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()


def test_linear_recurrence_in_chunks(skewed):
    df, pdf = skewed
    got = W.smooth(df, ["k"], "id", "t", 3, "ema", rows_per_task=7).toPandas().set_index("id").ema.sort_index()
    whole = W.smooth(df, ["k"], "id", "t", 3, "ema").toPandas().set_index("id").ema.sort_index()
    assert np.allclose(got.fillna(-1), whole.fillna(-1))
    hot = pdf[pdf.k == "hot"].sort_values("id").t.to_numpy(float)
    y = [hot[:3].mean()]
    for x in hot[3:]:
        y.append(0.5 * x + 0.5 * y[-1])
    ids = pdf[pdf.k == "hot"].sort_values("id").id.to_numpy()
    assert np.allclose(whole.loc[ids[2:]], y)


def test_string_order_and_null_keys(spark):
    df = spark.createDataFrame([("b", "key#10"), ("a", "key#2"), (None, "key#1"), (None, "key#11")], "g string, s string")
    rows = {(r.g, r.s): r.pos for r in O.row_positions(df, ["s"], slices=4).collect()}
    assert [k[1] for k, _ in sorted(rows.items(), key=lambda kv: kv[1])] == ["key#1", "key#10", "key#11", "key#2"]
    by = {(r.g, r.s): r.pos for r in O.row_positions(df, ["s"], ["g"], slices=4).collect()}
    assert by[(None, "key#1")] == 1 and by[(None, "key#11")] == 2


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k string, t int, v double")
    assert O.prefix_sum(empty, "t", {"v": F.col("v")}, ["k"]).count() == 0
    assert O.quantiles(empty, "v", [0.5], ["k"]).count() == 0
    one = spark.createDataFrame([("a", 1, 2.0)], "k string, t int, v double")
    assert O.quantiles(one, "v", [0.3]).first()[0] == 2.0


@pytest.mark.parametrize("partitions", ["4", "16"])
def test_nan_is_last_whatever_the_partitions(spark, partitions):
    rows = [(i, float(i % 97) if i % 100 else float("nan")) for i in range(1, 1001)] + [(2000, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pos = {r.id: r.pos for r in O.row_positions(df, ["v", "id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    nan = [i for i, v in rows if v is not None and v != v]
    assert pos[2000] == 1 and sorted(pos[i] for i in nan) == list(range(992, 1002))


def test_rows_without_actual_or_score_dont_count(spark):
    rows = [(1.0, 0.9), (0.0, 0.1), (None, 0.95), (None, 0.05), (1.0, None)]
    df = spark.createDataFrame(rows, "y double, p double")
    assert R.auc(df, "y", "p").first().auc == 1.0 and R.ks(df, "y", "p").first().ks == 1.0


@pytest.mark.parametrize("kind", ["ties", "nulls", "text", "nan second"])
def test_slices_are_even_and_in_order(spark, kind):
    r = np.random.default_rng(5)
    n = 20_000
    first = {"ties": np.where(r.random(n) < 0.8, 5.0, r.random(n) * 10), "nulls": np.where(r.random(n) < 0.5, np.nan, r.random(n)), "nan second": np.where(r.random(n) < 0.8, 5.0, r.random(n) * 10)}
    second = r.random(n)
    if kind == "text":
        values = [f"https://example.org/a/long/path/{i:08d}" for i in r.integers(0, n, n - 2)] + ["a", "z"]
    else:
        values = [None if x != x else float(x) for x in first[kind]]
    if kind == "nan second":
        second[:1000] = np.nan
    df = spark.createDataFrame([(i, v, float(w)) for i, (v, w) in enumerate(zip(values, second))], f"id long, v {'string' if kind == 'text' else 'double'}, w double").repartition(6)
    cut = O.slicer(df, ["v", "w", "id"], 32)(df)
    sizes = [x["count"] for x in cut.groupBy("_slice").count().collect()]
    assert max(sizes) <= 3 * n / 32
    rows = cut.orderBy("v", "w", "id").select("_slice").collect()
    assert all(a[0] <= b[0] for a, b in zip(rows, rows[1:]))
    got = O.row_positions(df, ["v", "w", "id"], slices=32).orderBy("pos").select("id").collect()
    assert [x[0] for x in got] == [x[0] for x in df.orderBy("v", "w", "id").select("id").collect()]
    back = O.row_positions(df, ["v", "w", "id"], slices=32, descending=True).orderBy(F.desc("pos")).select("id").collect()
    assert back == got
