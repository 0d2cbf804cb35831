"""Conservation, identity and edge-case properties of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import SeriesSpec
from tabloom.functions import dates as D, metrics as M, scalars as S, text as FT
from tabloom.operators import decisions as DE, effects as E, joins as J, models as MO, ranking as K, reshape as R, sampling as SA, series as T, sets as U, stats as ST, text as X, windows as W
from tabloom.session import table
from tabloom.sources import readers as RD
from tabloom.spec import nan_to_null

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scores(spark):
    r = np.random.default_rng(3)
    p = np.round(r.random(400), 2)
    y = (r.random(400) < p).astype(int)
    pdf = pd.DataFrame({"id": range(400), "y": y, "p": p, "w": r.integers(1, 4, 400).astype(float), "g": r.integers(0, 3, 400)})
    return spark.createDataFrame(pdf), pdf


def brute_auc(pdf):
    a, b = pdf[pdf.y == 1].p.to_numpy()[:, None], pdf[pdf.y == 0].p.to_numpy()[None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


def test_rank_metric_identities(scores):
    df, pdf = scores
    auc = K.auc(df, "y", "p").first()[0]
    assert auc == pytest.approx(brute_auc(pdf))
    d = K.pair_counts(df, "y", "p").first()
    assert auc == pytest.approx((d.somers_d + 1) / 2)
    assert d.concordant + d.discordant + d.tied == (pdf.y == 1).sum() * (pdf.y == 0).sum()
    assert K.gini_norm(df, "y", "p").first()[0] == pytest.approx(2 * auc - 1)
    assert K.gini_norm(df, "y", "p", "w").first()[0] == pytest.approx(2 * K.auc(df, "y", "p", "w").first()[0] - 1)


def test_metric_edges(spark):
    one = spark.createDataFrame([(1, 0.5, 0.0), (1, 0.5, 0.0)], "y int, p double, w double")
    assert K.auc(one, "y", "p").first()[0] == 1.0
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert K.auc(flat, "y", "p").first()[0] == 0.5
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    assert one.agg(M.rmse(y, p, w)).first()[0] == 0
    assert one.agg(M.r_squared(y, p)).first()[0] == 0
    sure = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double")
    assert sure.agg(M.logloss(y, p)).first()[0] == pytest.approx(-math.log(1e-15), rel=1e-4)
    zero = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0)], "y double, p double")
    assert zero.agg(M.smape(y, p)).first()[0] == pytest.approx(2 / 3)
    assert zero.agg(M.mape_signed(y, p)).first()[0] == pytest.approx(0.5)


def test_confusion_at_threshold_equality(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert DE.confusion_at(df, "y", "p", 0.5).first().asDict() == {"tp": 1, "fp": 1, "tn": 0, "fn": 0}
    strict = DE.confusion_at(df, "y", "p", 0.5, True).first().asDict()
    assert strict == {"tp": 0, "fp": 1, "tn": 0, "fn": 1}


def test_downsampling_keeps_weighted_mean(spark):
    df = spark.range(40000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    s = SA.downsample_majority(df, "y", 0, ["id"], 0.25, seed=1)
    r = s.agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("m"), F.count("*").alias("n")).first()
    assert r.m == pytest.approx(0.1, abs=0.003) and r.n < 15000


def test_partitions_cover_everything(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    p = SA.stratified_partition(df, "y", ["id"], 4, 0.2, seed=3)
    n = {(r.y, r.partition): r["count"] for r in p.groupBy("y", "partition").count().collect()}
    assert sum(n.values()) == 1000 and n[(0, "H")] == 160 and n[(1, "H")] == 40
    assert {n[(0, f"T{i}")] for i in range(1, 5)} == {160} and {n[(1, f"T{i}")] for i in range(1, 5)} == {40}
    again = SA.stratified_partition(df, "y", ["id"], 4, 0.2, seed=3)
    assert p.exceptAll(again).count() == 0
    g = SA.group_split(df.withColumn("k", F.col("id") % 50), ["k"], 0.7)
    assert g.select("k", "split").distinct().count() == 50


def test_permutation_keeps_values(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 3)
    p = E.permute_column(df, "v", "id", seed=5)
    assert sorted(r.v for r in p.collect()) == [i * 3 for i in range(500)]
    assert p.filter("v = id * 3").count() < 50


def brute_quota(rows, lo, hi, total):
    """The greedy rule on Python lists."""
    left, out, room = dict(rows), {}, dict(hi)
    names = list(lo)
    mean = {c: np.mean([r[c] for r in rows.values()]) for c in names}
    for c in sorted(names, key=lambda c: (mean[c], c)):
        for i in sorted(left, key=lambda i: (-left[i][c], -i))[: lo[c]]:
            out[i] = c
            del left[i]
            room[c] -= 1
    live = [c for c in names if room[c] > 0]
    while live and len(out) < total and left:
        best = {i: max(r[c] for c in live) for i, r in left.items()}
        for i in sorted(left, key=lambda i: (-best[i], -i)):
            c = next(c for c in live if left[i][c] == best[i])
            if room[c] == 0 or len(out) == total:
                break
            out[i] = c
            room[c] -= 1
            del left[i]
        live = [c for c in live if room[c] > 0]
    return out


def test_quota_assignment_equals_greedy(spark):
    r = np.random.default_rng(2)
    rows = {i: {"a": float(x), "b": float(y), "c": float(z)} for i, (x, y, z) in enumerate(np.round(r.random((120, 3)), 2))}
    df = spark.createDataFrame([(i, *v.values()) for i, v in rows.items()], "id long, a double, b double, c double")
    lo, hi = {"a": 5, "b": 10, "c": 0}, {"a": 30, "b": 25, "c": 40}
    got = {x.id: x.choice for x in DE.quota_assign(df, "id", ["a", "b", "c"], lo, hi, 80).collect()}
    assert got == brute_quota(rows, lo, hi, 80)
    assert len(got) == 80


def test_pairwise_correlation_blocks(spark):
    r = np.random.default_rng(4)
    wide = pd.DataFrame(r.random((40, 9)), columns=list("abcdefghi")).mask(r.random((40, 9)) < 0.2)
    long = wide.reset_index().melt("index", var_name="s", value_name="v").dropna()
    df = spark.createDataFrame(long.rename(columns={"index": "d"}))
    got = {(x.series_1, x.series_2): x["corr"] for x in R.pairwise_correlation(df, "s", "d", "v", block=4, date_slices=3).collect()}
    want = wide.corr()
    assert len(got) == 36
    assert all(v == pytest.approx(want.loc[a, b]) for (a, b), v in got.items())


def test_regression_tests_against_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.3 * x[:, 0] ** 2 + r.normal(size=300)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})
    df = spark.createDataFrame(pdf)
    a = np.column_stack([np.ones(300), x])
    beta, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    m = ST.ols(df, "y", ["a", "b"])
    assert np.allclose(m.coef, beta) and m.rss == pytest.approx(rss[0])
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    inf = ST.influence(df, "y", ["a", "b"]).toPandas().sort_values(["a"])
    assert np.allclose(np.sort(inf.leverage), np.sort(h)) and inf.leverage.sum() == pytest.approx(3)
    fit = a @ beta
    b = np.column_stack([a, fit**2, fit**3])
    rss2 = np.linalg.lstsq(b, y, rcond=None)[1][0]
    f = ((rss[0] - rss2) / 2) / (rss2 / 295)
    assert ST.reset_test(df, "y", ["a", "b"]).first().f == pytest.approx(f, rel=1e-6)
    e2 = (y - fit) ** 2
    aux = np.linalg.lstsq(a, e2, rcond=None)[1][0]
    lm = 300 * (1 - aux / ((e2 - e2.mean()) ** 2).sum())
    assert ST.heteroscedasticity(df, "y", ["a", "b"]).first().lm == pytest.approx(lm)
    z = np.sort((x[:, 0] - x[:, 0].mean()) / x[:, 0].std(ddof=1))
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, 301)
    a2 = -300 - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).sum() / 300
    assert ST.anderson_darling(df, ["a"]).first().a2 == pytest.approx(a2)
    aa = a / np.concatenate([[1], np.linalg.norm(x, axis=0)])
    ev = np.linalg.eigvalsh(aa.T @ aa)
    assert ST.condition_number(df, ["a", "b"]).first()[0] == pytest.approx(math.sqrt(ev[-1] / ev[0]))


def test_bootstrap_interval_covers_mean(spark):
    df = spark.range(3000).withColumn("v", (F.col("id") % 100).cast("double"))
    r = ST.bootstrap_ci(df, ["id"], "v", 100).first()
    assert r.lower < 49.5 < r.upper and r.sd == pytest.approx(28.87 / math.sqrt(3000), rel=0.35)


def test_null_tokens(spark):
    cells = [
        "1", "2", "I AM TEXT", "-NaN", "-nan", "null", "na", "n/a", "#N/A", "N/A", "?", ".", "Inf", "INF", "inf", "-inf", "-Inf", "-INF", " ",
        "None", "", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN", "NA", "NULL", "NaN", "nan",
    ]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    out = df.select("c", RD.nullify(F.col("c")).alias("t"), RD.to_number(F.col("c")).alias("n")).collect()
    kept = [r.t for r in out if r.t is not None]
    assert kept == ["1", "2", "I AM TEXT", "Inf", "INF", "inf", "-inf", "-Inf", "-INF"]
    assert [r.n for r in out if r.n is not None] == [1.0, 2.0] + [math.inf] * 3 + [-math.inf] * 3


def test_scalars(spark):
    df = spark.createDataFrame([("August 3rd 2019, 10:00:00", "1,234.5", "x_FD:1_FDW:-7_Cluster-c2")], "d string, n string, p string")
    r = df.select(S.ordinal_date(F.col("d")).cast("string").alias("d"), S.messy_number(F.col("n")).alias("n"), *[c.alias(k) for k, c in S.parse_composite(F.col("p")).items()]).first()
    assert (r.d, r.n, r.fd, r.fdw, r.cluster) == ("2019-08-03 10:00:00", 1234.5, "1", "-7", "c2")
    with pytest.raises(ValueError):
        S.sanitize_names(spark.createDataFrame([(1, 2)], ["a-b", "a.b"]))
    small = S.downcast(spark.createDataFrame([(1, 40000, 1.5), (127, 3, 2.5)], "a long, b long, c double"))
    assert dict(small.dtypes) == {"a": "smallint", "b": "int", "c": "float"}
    e = spark.createDataFrame([(60.0,), (61.0,), (43831.5,)], "s double").select(D.excel_serial(F.col("s")).cast("string").alias("t")).collect()
    assert [x.t for x in e] == [None, "1900-03-01 00:00:00", "2020-01-01 12:00:00"]
    nn = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert nn.filter("x is null").count() == 1


def test_checked_join_fails_on_duplicates(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        J.checked_join(a, b, ["k"])
    assert J.checked_join(a, b, ["k"], validate="1:m").count() == 2


def test_radius_with_copies_of_one_point(spark):
    """A third of the rows on one spot: copies are collapsed, counts stay exact."""
    r = np.random.default_rng(6)
    pts = [(0.0, 0.0)] * 60 + [tuple(map(float, x)) for x in r.integers(-4, 5, (120, 2))]
    df = spark.createDataFrame([(i, "g", x, y) for i, (x, y) in enumerate(pts)], "id long, g string, x double, y double")
    v = J.vicinity(df, ["g"], ["x", "y"], 2.0, {"n": (F.count(F.lit(1)), F.sum)})
    got = {r.id: r.n - 1 for r in df.join(v, ["g", "x", "y"]).collect()}
    a = np.array(pts)
    d = np.abs(a[:, None] - a[None]).sum(-1)
    assert got == {i: int((d[i] <= 2).sum() - 1) for i in range(len(pts))}
    n = {r.id: r.nearest for r in J.nearest_same(df.withColumn("c", F.lit("c")), ["g"], "c", ["x", "y"]).collect()}
    want = np.where(d > 0, d, np.inf).min(1)
    assert all(n[i] == want[i] for i in n)


def test_kaplan_meier_when_everyone_ends(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "t int, e int")
    km = [round(r.survival, 6) for r in MO.kaplan_meier(df, "t", "e").orderBy("t").collect()]
    assert km == [0.75, 0.5, 0.5, 0.0]


def test_series_edges(spark):
    spec = SeriesSpec()
    rows = [("a", f"2020-01-{d:02d}", 0.0) for d in range(1, 9)] + [("b", "2020-01-01", 1.0)]
    df = spark.createDataFrame(rows, "series_id string, d string, target double").select("series_id", F.to_timestamp("d").alias("date"), "target")
    assert {r.series_id for r in T.trim_zeros(df, spec, drop=True).collect()} == {"b"}
    assert T.trim_zeros(df, spec).filter("target is null").count() == 8
    assert T.infer_timestep(df, spec).first().asDict() == {"median_step": 86400.0, "unit": "day", "n": 1}
    odd = df.withColumn("date", F.timestamp_seconds(F.unix_seconds("date") * 1.01))
    with pytest.raises(Exception):
        T.infer_timestep(odd, spec).collect()
    with pytest.raises(TypeError):
        spec.check(df.withColumn("target", F.lit("x")))


def test_periodicity_finds_weekly_cycle(spark):
    df = spark.range(140).select(F.lit("a").alias("series_id"), F.timestamp_seconds(F.col("id") * 86400).alias("date"), ((F.col("id") % 7 == 2).cast("double") * 5 + F.rand(1)).alias("target"))
    got = {r.period: r.detected for r in T.periodicity(df, SeriesSpec(), "day").collect()}
    assert got["weekly"]


def test_exponential_smoothing_picks_best_alpha(spark):
    y = [3.0, 5.0, 4.0, 6.0, 7.0, 6.5, 8.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "series_id string, i int, target double").select("series_id", F.timestamp_seconds(F.col("i") * 86400).alias("date"), "target")
    r = T.exponential_smoothing(df, SeriesSpec(), [0.2, 0.5, 0.8]).first()

    def sse(a):
        level, out = y[0], []
        for v in y[1:]:
            out.append((v - level) ** 2)
            level = a * v + (1 - a) * level
        return np.mean(out), level

    best = min((0.2, 0.5, 0.8), key=lambda a: sse(a)[0])
    assert r.alpha == best and r.mse == pytest.approx(sse(best)[0]) and r.forecast == pytest.approx(sse(best)[1])


def test_hour_ending_on_both_change_days(spark):
    lab = [f"{i:02d}" for i in range(1, 25)]
    rows = [("2021-03-14", h) for h in lab if h != "03"] + [("2021-11-07", h) for h in [*lab[:2], "02X", *lab[2:]]]
    df = spark.createDataFrame(rows, "day string, he string").withColumn("day", F.to_date("day"))
    out = {(str(r.day), r.he): r.u for r in T.hour_ending_to_utc(df, "day", "he").withColumn("u", F.col("utc").cast("string")).collect()}
    assert out[("2021-03-14", "04")] == "2021-03-14 08:00:00" and out[("2021-11-07", "02X")] == "2021-11-07 07:00:00"
    assert out[("2021-11-07", "24")] == "2021-11-08 05:00:00"


def test_table_diff_counts_both_missing_as_equal(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, "x", float("nan"))], "k int, s string, v double")
    b = spark.createDataFrame([(1, None, 2.0), (2, "y", None)], "k int, s string, v double")
    got = {r["column"]: r.differ for r in U.table_diff(a, b, ["k"]).collect()}
    assert got == {"s": 1, "v": 1}


def test_text(spark):
    df = spark.createDataFrame([(1, "The été naïve_x ab 9lives cat cat time")], "d int, t string")
    assert df.select(FT.tokens(F.col("t"), FT.DOMAIN_STOP_WORDS).alias("w")).first().w == ["the", "naïve_x", "cat", "cat"]
    assert df.select(FT.tokens(F.col("t")).alias("w")).first().w == ["naïve_x", "cat", "cat"]  # English function words go, too
    assert df.select(FT.ngrams(F.split(F.lit("a b c"), " "), 3).alias("g")).first().g == ["a", "b", "c", "a b", "b c", "a b c"]
    assert df.select(FT.ngrams(F.split(F.lit("a"), " "), 3).alias("g")).first().g == ["a"]
    co = X.cooccurrence(df, "d", F.split(F.lit("a b a"), " "), 2).collect()
    assert {(r.a, r.b): r.n for r in co} == {("a", "b"): 2, ("a", "a"): 1}
    vec = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0, 1.0])], "term string, vector array<double>")
    tt = spark.createDataFrame([(0, "x"), (0, "y"), (0, "z")], "topic int, term string")
    assert X.coherence(tt, vec).first().coherence == pytest.approx((0 + 2 * math.sqrt(0.5)) / 3)


def test_nearest_vectors_in_blocks_with_ties(spark):
    r = np.random.default_rng(8)
    m = r.integers(-2, 3, (60, 4)).astype(float) + 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(5)
    got = {(x.query, x["rank"]): x.id for x in X.nearest_vectors(df.filter("id < 9"), df, "id", "v", 3, block=2).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(9):
        s = [(-round(float(u[q] @ u[i]), 9), i) for i in range(60) if i != q]
        assert [got[(q, k)] for k in (1, 2, 3)] == [i for _, i in sorted(s)[:3]]


def test_recursive_indicators_bounds(spark):
    rows = [("s", i, 10 + math.sin(i) + 0.5, 10 + math.sin(i) - 0.5, 10 + math.sin(i / 2) * 0.4) for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, i int, high double, low double, close double").withColumn("date", F.timestamp_seconds(F.col("i") * 86400))
    a = W.recursive_indicators(df, n=5).orderBy("date").collect()
    b = W.recursive_indicators(df, n=5, rows_per_task=9).orderBy("date").collect()
    assert all(x.rsi is None or 0 <= x.rsi <= 100 for x in a)
    for x, y in zip(a, b):
        for c in ("ema", "dema", "zlema", "rsi", "atr", "adx"):
            assert (x[c] is None and y[c] is None) or x[c] == pytest.approx(y[c])
    assert W.parabolic_sar(df).count() == 80


def test_ndcg_and_meta(spark):
    df = spark.createDataFrame([("a", 3, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), ("b", 1, 0.4)], "g string, rel int, p double")
    assert [(r.g, r.ndcg) for r in K.ndcg(df, ["g"], "rel", "p").collect()] == [("a", 1.0)]


def test_stream_equals_batch(spark):
    from tabloom.session import scratch_path
    from tabloom.streaming import jobs as G

    ev = table(spark, SF, "events")
    s = G.file_stream(spark, SF, ev.schema, names="events.parquet")
    path = scratch_path(spark, "t")
    G.run_to_table(G.service_stats(s, "ts", ["event_type"], "value"), spark, path, "complete")
    a, b = spark.read.parquet(path), G.service_stats(ev, "ts", ["event_type"], "value")
    assert a.count() == b.count() and a.select("start", "event_type", "n").exceptAll(b.select("start", "event_type", "n")).count() == 0


def test_late_actuals_stream_has_all_matches(spark):
    from tabloom.session import scratch_path
    from tabloom.streaming import jobs as G

    ev = table(spark, SF, "events")

    def sides(x):
        p = x.filter("event_type <> 'purchase'").select("event_id", "user_id", F.col("ts").alias("pt"))
        return p, x.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value")

    p, _ = sides(G.file_stream(spark, SF, ev.schema, names="events.parquet"))
    _, a = sides(G.file_stream(spark, SF, ev.schema, names="events.parquet"))
    path = scratch_path(spark, "t")
    G.run_to_table(G.late_actuals_join(p, a, "user_id", "pt", "at", "2 days"), spark, path)
    got, want = spark.read.parquet(path), G.late_actuals_join(*sides(ev), "user_id", "pt", "at", "2 days")
    assert want.filter("at is not null").exceptAll(got.filter("at is not null")).count() == 0
    # Predictions without an actual appear once the watermark passes their time, so only late ones are open.
    open_rows = want.filter("at is null").join(got, "event_id", "left_anti")
    last = ev.agg(F.max("ts")).first()[0]
    assert open_rows.filter(F.col("pt") < F.lit(last) - F.expr("interval 3 days")).count() == 0


def test_best_option_inside_the_row_equals_the_exploded_form(spark):
    from tabloom.operators import effects as E

    df, options = spark.range(7), {"a": [1.0, 2.0, 3.0], "b": [0, 1]}
    score = lambda o: F.pmod(F.col("id") * 3 + o["b"] * 2, F.lit(5)) * o["a"] - o["a"] * o["a"]
    one = E.best_option_by(df, options, score, "id").orderBy("id").collect()
    two = E.best_option(df, options, lambda x: x.withColumn("score", score({"a": F.col("a"), "b": F.col("b")})), "id").orderBy("id").collect()
    assert one == two
