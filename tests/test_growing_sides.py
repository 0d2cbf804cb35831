"""Sides that grow with the data are joined by a shuffle, and small results of large jobs are worked out once."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import effects as E, joins as J, models as M, order as O, sampling as S
from tabloom.spec import SeriesSpec


def final_plan(df):
    """The plan that ran, after the adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def places(spark):
    x = spark.range(900).selectExpr("id", "cast(id % 3 as string) as aisle", "cast(id % 5 as string) as color", "double(id % 41) as x", "double(id % 37) as y", "double(id % 7 + 1) as price")
    return x.unionByName(x.where("id < 9").selectExpr("id + 900 as id", "cast(null as string) as aisle", "color", "x", "y", "price")).localCheckpoint()


@pytest.mark.parametrize("job", [
    lambda p: J.radius_counts(p, ["aisle"], ["x", "y"], {"a": 3.0, "b": 6.0}),
    lambda p: J.nearest_same(p, ["aisle"], "color", ["x", "y"]),
    lambda p: M.price_vicinity(p, "id", ["aisle"], ["x", "y"], 6.0),
    lambda p: M.category_vicinity(p, "id", ["aisle"], ["x", "y"], 6.0, "color"),
], ids=["radius_counts", "nearest_same", "price_vicinity", "category_vicinity"])
def test_no_side_of_a_neighbour_join_is_broadcast(places, job):
    assert "Broadcast" not in final_plan(job(places))


def test_radius_counts_by_shuffle_are_the_pairs(places):
    got = {r.id: (r.a, r.b) for r in J.radius_counts(places, ["aisle"], ["x", "y"], {"a": 3.0, "b": 6.0}).collect()}
    rows = places.collect()
    for r in rows[::50] + rows[-9:]:
        near = [abs(r.x - s.x) + abs(r.y - s.y) for s in rows if s.aisle == r.aisle]
        assert got[r.id] == tuple(sum(d <= e for d in near) - 1 for e in (3.0, 6.0))


def reads_once(spark, job):
    """How often ``job`` works out its input: every row of the input is counted when it is read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = spark.range(1000).selectExpr("cast(id % 20 as string) as s", "cast(date_add(date '2020-01-01', cast(id % 50 as int)) as timestamp) as d", "double(id % 13) as v")
    job(x.mapInArrow(count, x.schema)).collect()
    return seen.value / 1000


SPEC = SeriesSpec("s", "d", "v")


@pytest.mark.parametrize("job", [lambda x: S.top_series(x, SPEC, 5), lambda x: S.sample_series(x, SPEC, 0.4, "target")], ids=["top_series", "sample_series"])
def test_series_are_chosen_from_means_worked_out_once(spark, job):
    assert reads_once(spark, job) <= 2  # the means, and the rows of the chosen series


def test_an_assortment_is_ranked_from_values_worked_out_once(spark):
    items = ["0", "1", "2"]
    job = lambda x: E.assortment_value(E.item_sets(x, items, [2]), x.groupBy("s").agg(F.sum("v").alias("u")), items, "s", "u")
    assert reads_once(spark, job) <= 1


def test_options_of_a_small_file_are_scored_in_all_tasks(spark):
    df = spark.range(64).withColumn("k", F.when(F.col("id") % 5 > 0, F.col("id") % 3)).coalesce(1)
    out = E.best_option_by(df, {"a": [1, 2, 3], "b": [0, 5]}, lambda o: o["a"] * F.coalesce("k", F.lit(0)) - o["b"], "k")
    got = sorted((r.k if r.k is not None else -1, r.a, r.b, r.score) for r in out.collect())
    assert got == sorted((k, 3 if max(k, 0) else 1, 0, 3 * max(k, 0)) for k in (i % 3 if i % 5 else -1 for i in range(64)))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_left_range_join_forms_its_pairs_once(spark):
    l = spark.createDataFrame([(0, 10.2), (1, 10.7), (2, 11.5), (3, 40.0), (4, 7.0), (5, None), (6, 12.3), (7, 12.9)], "id long, p double").selectExpr("id", "timestamp_micros(cast(p * 1000000 as long)) as p")
    r = spark.createDataFrame([(0, 10.5, 12.5), (1, 20.1, 20.2), (2, 6.9, 7.0), (3, 12.4, 12.6), (4, 50.0, 30.0), (5, 11.4, 11.6)], "k long, a double, b double")
    r = r.selectExpr("k", "timestamp_micros(cast(a * 1000000 as long)) as a", "timestamp_micros(cast(b * 1000000 as long)) as b")
    out = J.range_join(l, "p", r, "a", "b", "left")
    assert sorted((x.id, -1 if x.k is None else x.k) for x in out.collect()) == [(0, -1), (1, 0), (2, 0), (2, 5), (3, -1), (4, 2), (5, -1), (6, 0), (7, -1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_few_groups_meet_their_rows_without_a_shuffle(spark):
    df = spark.range(300).selectExpr("id", "if(id % 3 = 0, null, id % 3) as g", "double(id) as v")
    plain = lambda x: sorted((r.id, r.m) for r in x.select("id", F.round("m", 6).alias("m")).collect())
    out = O.group_transform(df, ["g"], {"m": F.avg("v")}, few=True)
    assert plain(out) == plain(O.group_transform(df, ["g"], {"m": F.avg("v")}))
    assert "Exchange hashpartitioning" not in final_plan(out)
