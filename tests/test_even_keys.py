"""Many small keys are windowed by the key alone, tasks hold a bounded number of rows, and small tables of months are written once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.operators import order as O, windows as W
from tabloom.plans.aggregates import brand_month
from tabloom.plans.fixtures import Tables
from tabloom.plans.registry import QUERIES, load_all
from tabloom.session import dealt
from tabloom.streaming import jobs as J, keyed as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(cols).collect()))


@pytest.fixture(scope="module")
def many(spark):
    """2 000 rows of 200 keys, NULL among them, with ties in time, NULL times and NULL values."""
    return spark.range(2000).selectExpr(
        "id", "if(id % 200 = 7, null, id % 200) as k", "if(id % 17 = 0, null, (id * 7919) % 23) as t", "if(id % 5 = 0, null, double(id % 9)) as v", "cast(id % 4 as string) as item"
    ).localCheckpoint()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Line items of 400 suppliers, orders of 300 customers, parts of three brands and events of 300 users; some keys NULL."""
    d = str(tmp_path_factory.mktemp("even"))
    spark.range(4000).selectExpr(
        "id % 1200 as l_orderkey", "id % 60 as l_partkey", "if(id % 400 = 3, null, id % 400) as l_suppkey", "cast(id % 7 as int) as l_linenumber", "double((id * 31) % 6) as l_quantity",
        "double(id % 91) as l_extendedprice", "double(id % 10) / 100 as l_discount", "double(id % 8) / 100 as l_tax", "'R' as l_returnflag", "'O' as l_linestatus",
        "timestamp '1997-01-01' + make_dt_interval(cast((id * 37) % 700 as int)) as l_shipdate",
    ).write.parquet(f"{d}/lineitem.parquet")
    spark.range(1200).selectExpr(
        "id as o_orderkey", "if(id % 300 = 5, null, id % 300) as o_custkey", "'O' as o_orderstatus", "double(id) as o_totalprice", "timestamp '1997-01-01' + make_dt_interval(cast(id % 40 as int)) as o_orderdate", "'5-LOW' as o_orderpriority"
    ).write.parquet(f"{d}/orders.parquet")
    spark.range(60).selectExpr("id as p_partkey", "'x' as p_name", "concat('Brand#', id % 3 + 1) as p_brand", "'T' as p_type", "1 as p_size", "double(id) as p_retailprice").write.parquet(f"{d}/part.parquet")
    return d


def test_even_keys(spark, many):
    assert O.even_keys(many, ["k"]) == 2000
    assert O.even_keys(many.withColumn("k", F.when(F.col("id") % 3 > 0, F.col("k"))), ["k"]) == 0  # a third is NULL
    assert O.even_keys(many.withColumn("k", F.lit(1)), ["k"]) == 0
    assert O.even_keys(many.where("false"), ["k"]) == 0


@pytest.mark.parametrize("job", [
    lambda x, e: O.prefix_sum(x, "t", {"s": F.col("v"), "n": F.lit(1)}, ["k"], even=e),
    lambda x, e: O.prefix_sum(x, "t", {"s": F.col("v")}, ["k"], descending=True, even=e),
    lambda x, e: O.row_positions(x, ["t", "id"], ["k"], even=e),
    lambda x, e: O.row_positions(x, ["t", "id"], ["k"], descending=True, even=e),
    lambda x, e: O.carry_last(x, ["t", "id"], ["v"], ["k"], even=e),
    lambda x, e: O.carry_last(x, ["t", "id"], ["v"], ["k"], forward=True, even=e),
], ids=["sum", "sum_down", "position", "position_down", "carry", "carry_back"])
def test_windows_of_even_keys_are_those_of_slices(many, job):
    plain, sliced = job(many, True), job(many, False)
    assert rows(plain) == rows(sliced)
    assert "Join" not in plan(plain) and "Join" in plan(sliced)


def test_rolling_mode_query_shuffles_once(spark, folder):
    load_all()
    out = QUERIES["W05_rolling_mode"](spark, folder)
    assert plan(out).count("Exchange") == 1 and "lambda" not in plan(out)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    groups: dict = {}
    for r in sorted(spark.read.parquet(f"{folder}/lineitem.parquet").collect(), key=lambda r: [r[c] for c in order]):
        groups.setdefault(r.l_suppkey, []).append(r.l_quantity)
    want = set()
    for k, q in groups.items():
        for i in range(len(q)):
            last = q[max(0, i - 9) : i + 1]
            want.add((k, i + 1, min(last, key=lambda v: (-last.count(v), v))))
    assert {tuple(r) for r in out.select("l_suppkey", "pos", "mode").collect()} == want


def test_rolling_mode_of_zeros_nulls_and_nan(spark):
    values = [1.0, -0.0, 0.0, None, float("nan"), float("nan"), float("nan"), 2.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, t int, v double")
    got = [r.mode for r in W.rolling_mode(df, ["k"], ["t"], "v", 4).orderBy("t").collect()]
    assert [str(x).replace("-0.0", "0.0") for x in got] == ["1.0", "0.0", "0.0", "0.0", "0.0", "nan", "nan", "nan"]
    assert W.rolling_mode(df.where("v is null"), ["k"], ["t"], "v", 4).first().mode is None


def test_sessions_of_many_users_need_no_slices(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(None if i % 300 == 9 else i % 300, start + dt.timedelta(minutes=(i * 131) % 5000), float(i % 9)) for i in range(3000)], "u long, t timestamp, v double")
    df.repartition(4, "v").write.parquet(str(tmp_path / "in"))
    got = K.session_stats(J.file_stream(spark, str(tmp_path / "in"), df.schema, max_files=1), "t", ["u"], "v", "30 minutes")
    g = df.groupBy(F.session_window("t", "30 minutes").alias("w"), "u").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    assert rows(got) == rows(g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "u", "n", "total"))
    assert "Join" not in plan(got)


def test_tasks_are_dealt_by_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    x = spark.range(100)
    assert [dealt(x, n, "id").rdd.getNumPartitions() for n in (0, 100, 250_000 * (cores + 3))] == [cores, cores, cores + 3]


def test_history_counts_are_dealt_by_key_once(spark, many, folder):
    values = ["0", "1", "2"]
    out = W.history_counts(many, ["k"], "t", "item", values)
    assert plan(out).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(out) and "Join" not in plan(out)
    uneven = W.history_counts(many.withColumn("k", F.col("id") % 2), ["k"], "t", "item", values)
    for got, key in ((out, lambda r: r.k), (uneven, lambda r: r.id % 2)):
        src = many.collect()
        for r in got.collect()[::15]:
            early = [x.item for x in src if key(x) == r.k and r.t is not None and (x.t is None or x.t < r.t)]
            assert [r[f"n_{v}"] for v in values] == [early.count(v) for v in values]
    assert plan(Tables(spark, folder).history).count("REPARTITION_BY_NUM") == 2  # the join and the distinct rows


def test_months_of_brands_are_written_once(spark, folder):
    t = Tables(spark, folder)
    months = brand_month(t)
    assert "Join" not in plan(months) and "lineitem" not in plan(months)
    sums = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("s"), F.date_trunc("month", "l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v"))
    assert rows(months) == rows(sums)
