"""Inputs of the registered queries: the given tables and views derived from all their rows.

Every view exists twice: as DataFrame code on ``Tables`` and as a SQL CTE for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.session import dealt, table

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

V_SERIES = """v_series as (
  select event_type as series_id, date_trunc('day', ts)::timestamp as date, sum(value) as target
  from events group by 1, 2)"""
V_GAP = V_SERIES + """, v_gap as (
  select * from v_series where (day(date) * 7 + length(series_id)) % 5 <> 0)"""
V_ZERO = V_SERIES + """, v_zero as (
  select series_id, date, case when series_id in ('click', 'error')
    and (date < (select min(date) from v_series) + interval 6 day
      or date > (select max(date) from v_series) - interval 6 day) then 0.0::double else target end as target
  from v_series)"""
V_SCORES = """v_scores as (
  select l_orderkey, l_partkey, l_suppkey, case when l_returnflag = 'R' then 1 else 0 end as y,
    least(greatest((l_discount * 10 + l_quantity / 50) / 2, 1e-6::double), 1 - 1e-6::double) as p,
    1 + l_tax as w, l_linestatus as grp, l_returnflag as flag, l_extendedprice as actual, l_quantity * 1500 as pred
  from lineitem)"""
V_HISTORY = """v_history as (
  select distinct o_custkey as cust_id, o_orderdate as dt, p_type as line_number, p_brand as size
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey)"""
V_TRIPLES = """v_triples as (
  select o_custkey as project, p_brand as item, max(l_discount) as score
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
  group by 1, 2 having max(l_discount) <> 0)"""
V_RUNS = """v_runs as (
  select o_orderstatus as run, p_brand as file, p_type as y_type, date_trunc('day', o_orderdate)::timestamp as project_date,
    l_discount as gini_p, l_discount * (1 - l_tax) as gini_h, l_quantity as ram, l_extendedprice as total_time
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
  where o_orderstatus in ('F', 'O'))"""
V_SURVIVAL = """v_survival as (
  select o_custkey as id, date_diff('day', min(o_orderdate), max(o_orderdate)) as tenure,
    case when max(o_orderdate) < timestamp '2001-01-01' then 1 else 0 end as event, any_value(c_mktsegment) as segment
  from orders join customer on c_custkey = o_custkey group by 1)"""
V_TOUCH = """v_touch as (
  select o_custkey as id,
    max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as facebook,
    max(case when o_orderpriority = '2-HIGH' then 1 else 0 end) as search,
    max(case when o_orderpriority = '3-MEDIUM' then 1 else 0 end) as sms,
    max(case when o_orderstatus = 'F' then 1 else 0 end) as purchase
  from orders group by 1)"""
V_PROBS = """v_probs as (
  select o_custkey as id,
    sum(case when o_orderpriority = '1-URGENT' then o_totalprice else 0 end) / sum(o_totalprice) as app,
    sum(case when o_orderpriority = '2-HIGH' then o_totalprice else 0 end) / sum(o_totalprice) as text,
    sum(case when o_orderpriority = '3-MEDIUM' then o_totalprice else 0 end) / sum(o_totalprice) as email
  from orders group by 1)"""
V_POINTS = """v_points as (
  select p_partkey as id, p_brand as aisle, p_type as color, p_size::double as x, p_retailprice / 100 as y,
    (p_partkey % 10)::double as z, p_retailprice as price
  from part)"""
V_CALENDAR = """v_calendar as (
  select * from (values (timestamp '1995-07-04', 'independence'), (timestamp '1996-07-04', 'independence'),
    (timestamp '1997-07-04', 'independence'), (timestamp '1998-07-04', 'independence'), (timestamp '1999-07-04', 'independence'),
    (timestamp '2000-07-04', 'independence'), (timestamp '2001-07-04', 'independence'), (timestamp '1995-12-25', 'christmas'),
    (timestamp '1996-12-25', 'christmas'), (timestamp '1997-12-25', 'christmas'), (timestamp '1998-12-25', 'christmas'),
    (timestamp '1999-12-25', 'christmas'), (timestamp '2000-12-25', 'christmas'), (timestamp '2024-01-01', 'new year'),
    (timestamp '2024-01-15', 'king day'), (timestamp '2024-01-26', 'sale')) as t(date, event))"""
V_BARS = """v_bars as (
  select l_partkey % 5 as symbol, l_shipdate as date,
    arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity)) as open,
    max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity)) as close,
    sum(l_quantity) as volume
  from lineitem group by 1, 2)"""

CALENDAR = [
    *[(f"{y}-07-04", "independence") for y in range(1995, 2002)],
    *[(f"{y}-12-25", "christmas") for y in range(1995, 2001)],
    ("2024-01-01", "new year"),
    ("2024-01-15", "king day"),
    ("2024-01-26", "sale"),
]


class Tables:
    """Lazy access to the tables of one folder and to the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return table(self.spark, self.dir, name)
        raise AttributeError(name)

    @cached_property
    def series(self) -> DataFrame:
        return self.events.groupBy(
            F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").alias("date")
        ).agg(F.sum("value").alias("target"))

    @cached_property
    def gap(self) -> DataFrame:
        return self.series.filter((F.dayofmonth("date") * 7 + F.length("series_id")) % 5 != 0)

    @cached_property
    def zero(self) -> DataFrame:
        ends = self.series.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        edge = (F.col("date") < F.col("lo") + F.expr("interval 6 days")) | (
            F.col("date") > F.col("hi") - F.expr("interval 6 days")
        )
        return self.series.crossJoin(F.broadcast(ends)).select(
            "series_id",
            "date",
            F.when(F.col("series_id").isin("click", "error") & edge, 0.0).otherwise(F.col("target")).alias("target"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        raw = (F.col("l_discount") * 10 + F.col("l_quantity") / 50) / 2
        return self.lineitem.select(
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
            F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"),
            (1 + F.col("l_tax")).alias("w"),
            F.col("l_linestatus").alias("grp"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_extendedprice").alias("actual"),
            (F.col("l_quantity") * 1500).alias("pred"),
        )

    @cached_property
    def star(self) -> DataFrame:
        lines = dealt(self.lineitem, self.lineitem.count(), "l_orderkey")
        return self.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(
            self.part, F.col("p_partkey") == F.col("l_partkey")
        )

    @cached_property
    def history(self) -> DataFrame:
        rows = self.star.select(
            F.col("o_custkey").alias("cust_id"),
            F.col("o_orderdate").alias("dt"),
            F.col("p_type").alias("line_number"),
            F.col("p_brand").alias("size"),
        )
        return dealt(rows, self.lineitem.count(), *rows.columns).distinct()

    @cached_property
    def triples(self) -> DataFrame:
        return (
            self.star.groupBy(F.col("o_custkey").alias("project"), F.col("p_brand").alias("item"))
            .agg(F.max("l_discount").alias("score"))
            .filter("score <> 0")
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.star.filter(F.col("o_orderstatus").isin("F", "O")).select(
            F.col("o_orderstatus").alias("run"),
            F.col("p_brand").alias("file"),
            F.col("p_type").alias("y_type"),
            F.date_trunc("day", "o_orderdate").alias("project_date"),
            F.col("l_discount").alias("gini_p"),
            (F.col("l_discount") * (1 - F.col("l_tax"))).alias("gini_h"),
            F.col("l_quantity").alias("ram"),
            F.col("l_extendedprice").alias("total_time"),
        )

    @cached_property
    def survival(self) -> DataFrame:
        last = F.max("o_orderdate")
        return (
            self.orders.join(self.customer, F.col("c_custkey") == F.col("o_custkey"))
            .groupBy(F.col("o_custkey").alias("id"))
            .agg(
                F.datediff(last, F.min("o_orderdate")).cast("long").alias("tenure"),
                F.when(last < F.to_timestamp(F.lit("2001-01-01")), 1).otherwise(0).alias("event"),
                F.first("c_mktsegment").alias("segment"),
            )
        )

    @cached_property
    def touch(self) -> DataFrame:
        def flag(col, v):
            return F.max(F.when(F.col(col) == v, 1).otherwise(0))

        return self.orders.groupBy(F.col("o_custkey").alias("id")).agg(
            flag("o_orderpriority", "1-URGENT").alias("facebook"),
            flag("o_orderpriority", "2-HIGH").alias("search"),
            flag("o_orderpriority", "3-MEDIUM").alias("sms"),
            flag("o_orderstatus", "F").alias("purchase"),
        )

    @cached_property
    def probs(self) -> DataFrame:
        def share(v):
            return F.sum(F.when(F.col("o_orderpriority") == v, F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice")

        return self.orders.groupBy(F.col("o_custkey").alias("id")).agg(
            share("1-URGENT").alias("app"), share("2-HIGH").alias("text"), share("3-MEDIUM").alias("email")
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("aisle"),
            F.col("p_type").alias("color"),
            F.col("p_size").cast("double").alias("x"),
            (F.col("p_retailprice") / 100).alias("y"),
            (F.col("p_partkey") % 10).cast("double").alias("z"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.spark.createDataFrame(CALENDAR, "d string, event string").select(
            F.to_timestamp("d").alias("date"), "event"
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Daily open, high, low, close and volume of five part groups, from every line."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        key = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
        return self.lineitem.groupBy((F.col("l_partkey") % 5).alias("symbol"), F.col("l_shipdate").alias("date")).agg(
            F.min_by(price, key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, key).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
