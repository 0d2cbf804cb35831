"""Joins."""

from pyspark.sql import functions as F

from tabloom.operators import joins as J
from tabloom.operators.order import prefix_sum
from tabloom.plans.fixtures import V_CALENDAR, V_HISTORY, V_POINTS, V_SERIES, V_TOUCH, V_TRIPLES
from tabloom.plans.registry import query



def N():
    return F.count(F.lit(1))



@query(
    "J01_inner",
    "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on c_custkey = o_custkey group by 1",
    digits=2,
)
def j01(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment").agg(N().alias("n"), F.sum("o_totalprice").alias("total"))


@query("J02_left_outer", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
def j02(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(
    "J03_full_outer_suffix",
    """with a as (select p_brand, p_size % 20 as slot, count(*) as n from part where p_size <= 25 group by 1, 2),
    b as (select p_brand, p_size % 20 as slot, count(*) as n from part where p_size > 25 group by 1, 2)
    select p_brand, slot, a.n as n_old, b.n as n_new from a full join b using (p_brand, slot)""",
)
def j03(t):
    keys = ["p_brand", (F.col("p_size") % 20).alias("slot")]
    a = t.part.filter("p_size <= 25").groupBy(*keys).agg(N().alias("n"))
    b = t.part.filter("p_size > 25").groupBy(*keys).agg(N().alias("n"))
    return J.suffixed_full_join(a, b, ["p_brand", "slot"], ("_old", "_new"))


@query(
    "J04_semi",
    """select o_orderkey, o_custkey from orders where o_custkey in
    (select o_custkey from orders group by 1 order by sum(o_totalprice) desc, 1 limit 100)""",
)
def j04(t):
    top = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(100)
    return t.orders.join(F.broadcast(top), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(
    "J05_anti",
    "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
)
def j05(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query(
    "J06_prior_pairs",
    f"""with {V_HISTORY}, d as (select cust_id, dt, count(*) as items from v_history group by 1, 2)
    select a.cust_id, a.dt, count(b.dt) as prior_dates, coalesce(sum(b.items), 0)::bigint as prior_items
    from d a left join d b on a.cust_id = b.cust_id and b.dt < a.dt group by 1, 2""",
)
def j06(t):
    """Theta self-join (earlier purchases of the customer) in aggregate: running totals, no pairs."""
    d = t.history.groupBy("cust_id", "dt").agg(N().alias("items"))
    s = prefix_sum(d, "dt", {"i": F.col("items"), "d": F.lit(1)}, ["cust_id"])
    return s.select("cust_id", "dt", (F.col("cum_d") - F.col("d")).alias("prior_dates"), (F.col("cum_i") - F.col("i")).alias("prior_items"))


@query(
    "J07_cross_grid",
    """select c_mktsegment, price, offer, count(*) as n, round(sum(c_acctbal * price), 2) as v from customer
    cross join (values (1.0::double), (1.5), (2.0)) g(price) cross join (values ('a'), ('b')) h(offer) group by 1, 2, 3""",
    digits=2,
)
def j07(t):
    x = J.cross_values(t.customer, {"price": [1.0, 1.5, 2.0], "offer": ["a", "b"]})
    return x.groupBy("c_mktsegment", "price", "offer").agg(N().alias("n"), F.sum(F.col("c_acctbal") * F.col("price")).alias("v"))


@query(
    "J08_range_join",
    f"""with {V_CALENDAR} select o_orderkey, event, date as event_date from orders
    join v_calendar on date between o_orderdate and o_orderdate + interval 7 day""",
)
def j08(t):
    cal = t.calendar.withColumn("low", F.col("date") - F.expr("interval 7 days"))
    out = J.range_join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", cal, "low", "date")
    return out.select("o_orderkey", "event", F.col("date").alias("event_date"))


@query(
    "J08_range_left",
    """with w as (select o_orderkey as w_key, o_orderdate as low, o_orderdate + to_days((o_orderkey % 400)::int) as high from orders where o_orderpriority = '1-URGENT' and o_totalprice > 250000)
    select event_type, user_id, ts, w_key from (select distinct event_type, user_id, ts - interval 25 years as ts from events) e left join w on ts between low and high""",
)
def j08b(t):
    """Intervals of very different lengths, and points that lie in none."""
    w = t.orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 250000").select(F.col("o_orderkey").alias("w_key"), F.col("o_orderdate").alias("low"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 400 as int))").alias("high"))
    e = t.events.select("event_type", "user_id", (F.col("ts") - F.expr("interval 25 years")).alias("ts")).distinct()
    return J.range_join(e, "ts", w, "low", "high", "left").select("event_type", "user_id", "ts", "w_key")


ASOF = """l as (select o_orderkey, o_custkey as k, o_orderdate as t from orders where o_orderpriority <> '1-URGENT'),
    r as (select o_custkey as k, o_orderdate as t, max(o_totalprice) as price from orders where o_orderpriority = '1-URGENT' group by 1, 2)"""


def asof_sides(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), "o_totalprice", "o_orderpriority")
    left = o.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "k", "t")
    right = o.filter("o_orderpriority = '1-URGENT'").groupBy("k", "t").agg(F.max("o_totalprice").alias("price"))
    return left, right


@query(
    "J09_asof_backward",
    f"with {ASOF} select o_orderkey, l.k, l.t, r.t as t_right, price from l asof left join r on l.k = r.k and l.t >= r.t",
)
def j09(t):
    return J.asof_join(*asof_sides(t), ["k"], "t")


@query(
    "J09_asof_forward",
    f"with {ASOF} select o_orderkey, l.k, l.t, r.t as t_right, price from l asof left join r on l.k = r.k and l.t <= r.t",
)
def j09b(t):
    return J.asof_join(*asof_sides(t), ["k"], "t", "forward")


@query(
    "J10_rolling_join",
    f"""with {ASOF}, f as (select k, arg_min(price, t) as first_price from r group by 1)
    select o_orderkey, l.k, l.t, coalesce(price, first_price) as price
    from l asof left join r on l.k = r.k and l.t >= r.t left join f on l.k = f.k""",
)
def j10(t):
    return J.rolling_join(*asof_sides(t), ["k"], "t", "price")


TIED = """l as (select o_orderkey, o_custkey as k, o_orderdate as t from orders where o_orderpriority <> '1-URGENT'),
    r as (select o_custkey as k, o_orderdate as t, o_totalprice as price, o_orderkey as r_key from orders where o_orderpriority = '1-URGENT')"""


@query(
    "J09_asof_ties",
    f"""with {TIED}, b as (select *, row_number() over (partition by k, date_trunc('month', t) order by price desc, r_key desc) as nth from r),
    m as (select k, date_trunc('month', t)::timestamp as t, price, r_key from b where nth = 1) select o_orderkey, l.k, l.t, m.t as t_right, price, r_key from l asof left join m on l.k = m.k and l.t >= m.t""",
)
def j09c(t):
    """Right rows that tie in time: of all urgent orders of a month the dearest counts."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    right = o.filter("o_orderpriority = '1-URGENT'").select("k", F.date_trunc("month", "t").alias("t"), "price", F.col("o_orderkey").alias("r_key"))
    return J.asof_join(o.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", "k", "t"), right, ["k"], "t", ties=["price", "r_key"])


@query("J11_checked_join", "select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey")
def j11(t):
    n = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.checked_join(t.supplier, n, ["s_nationkey"], "inner", "m:1").select("s_suppkey", "n_name")


@query("J12_positional_join", "select event_id, value, round(value * 2, 6) as prediction from events")
def j12(t):
    preds = t.events.select("event_id", (F.col("value") * 2).alias("prediction"))
    return J.positional_join(t.events.select("event_id", "value"), preds, "event_id")


NEAR = " + ".join(f"abs(a.{c} - b.{c})" for c in "xyz")


@query(
    "J13_radius_counts",
    f"""with {V_POINTS} select a.id, """
    + ", ".join(f"count(b.id) filter (where {NEAR} <= {r}) as n_{r}" for r in (2, 4, 8, 16))
    + " from v_points a join v_points b on a.aisle = b.aisle and a.id <> b.id group by 1",
)
def j13(t):
    """Neighbours within four radii in the same aisle, the row itself excluded."""
    out = J.radius_counts(t.points, ["aisle"], ["x", "y", "z"], {f"n_{r}": float(r) for r in (2, 4, 8, 16)})
    return out.select("id", "n_2", "n_4", "n_8", "n_16")


@query(
    "J14_nearest_same",
    f"""with {V_POINTS} select a.id, round(coalesce(min({NEAR}) filter (where {NEAR} > 0), 99999), 6) as nearest
    from v_points a left join v_points b on a.aisle = b.aisle and a.color = b.color group by 1""",
)
def j14(t):
    return J.nearest_same(t.points, ["aisle"], "color", ["x", "y", "z"]).select("id", "nearest")


COSINE = """q as (select item, score from v_triples where project = 0),
    sims as (select t.project, sum(t.score * q.score) / (n.norm * (select sqrt(sum(score * score)) from q)) as similarity
      from v_triples t join q using (item) join (select project, sqrt(sum(score * score)) as norm from v_triples group by 1) n using (project)
      group by t.project, n.norm)"""


@query("J15_cosine_join", f"with {V_TRIPLES}, {COSINE} select project, round(similarity, 6) as similarity from sims")
def j15(t):
    q = t.triples.filter("project = 0").select("item", "score")
    return J.cosine_join(t.triples, q, "project", "item", "score")


@query("J16_scalar_subquery", "select event_id, round(value / (select sqrt(sum(value * value)) from events), 9) as unit from events", digits=9)
def j16(t):
    norm = t.events.agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    return t.events.crossJoin(F.broadcast(norm)).select("event_id", (F.col("value") / F.col("norm")).alias("unit"))


@query(
    "J17_dual_lookup",
    """with d as (select distinct l_suppkey, o_custkey from orders join lineitem on l_orderkey = o_orderkey)
    select s_suppkey, c_custkey, a.n_name as s_nation_n_name, b.n_name as c_nation_n_name from customer left join d on o_custkey = c_custkey full join supplier on s_suppkey = l_suppkey
    left join nation a on a.n_nationkey = s_nationkey left join nation b on b.n_nationkey = c_nationkey""",
)
def j17(t):
    """Every customer with the suppliers of its orders, and suppliers without any."""
    dealt = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    pairs = t.customer.join(dealt, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "full")
    pairs = pairs.select("s_suppkey", "c_custkey", F.col("s_nationkey").alias("s_nation"), F.col("c_nationkey").alias("c_nation"))
    return J.dual_lookup(pairs, ["s_nation", "c_nation"], t.nation, "n_nationkey", "n_name").drop("s_nation", "c_nation")


@query(
    "J18_lattice_join",
    f"""with {V_TOUCH}, b as (select id, facebook + 2 * search + 4 * sms as bits from v_touch)
    select id, bits, s.sub::int as sub from b join (select unnest(range(8)) as sub) s on (bits & s.sub) = s.sub""",
)
def j18(t):
    return J.lattice(t.touch, ["facebook", "search", "sms"]).select("id", "bits", "sub")


@query(
    "J19_outer_fold",
    """with a as (select o_custkey as k, count(*) as v from orders where o_orderstatus = 'F' group by 1),
    b as (select o_custkey as k, count(*) as v from orders where o_orderstatus = 'O' group by 1),
    c as (select o_custkey as k, count(*) as v from orders where o_orderstatus = 'P' group by 1)
    select k, a.v as F, b.v as O, c.v as P from a full join b using (k) full join c using (k)""",
)
def j19(t):
    frames = {
        s: t.orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(N().alias("v")) for s in "FOP"
    }
    return J.outer_fold(frames, ["k"], "v")


@query(
    "J20_star_join",
    """select p_type, n_name, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join part on p_partkey = l_partkey
    join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2""",
    digits=2,
)
def j20(t):
    fact = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    dims = {
        "p_partkey": t.part.select("p_partkey", "p_type"),
        "s_suppkey": t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")),
        "n_nationkey": t.nation.select("n_nationkey", "n_name"),
    }
    return J.join_star(fact, dims).groupBy("p_type", "n_name").agg(N().alias("n"), F.sum("l_extendedprice").alias("total"))


@query(
    "J21_relationships",
    """select o.o_orderkey, count(e.event_id) as count, round(sum(e.value), 4) as sum_value, min(e.value) as min_value, max(e.value) as max_value
    from (select o_orderkey, o_custkey, timestamp '2024-01-01' + to_days((o_orderkey % 30)::int) + interval 5 hour as p from orders) o
    left join (select c_custkey as cust, c_custkey % (select max(user_id) + 1 from events) as prof from customer) c on c.cust = o.o_custkey
    left join events e on e.user_id = c.prof and e.ts::date >= o.p::date - 14 and e.ts::date <= o.p::date - 1 group by 1""",
    digits=4,
)
def j21(t):
    """Order -> customer -> the user that its number falls on -> events, window of 14 days up to the day before the point."""
    point = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"), F.lit(5))
    base = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), point.alias("p"))
    users = t.events.agg((F.max("user_id") + 1).alias("users"))
    profile = t.customer.crossJoin(F.broadcast(users)).select("c_custkey", (F.col("c_custkey") % F.col("users")).cast("long").alias("user_id"))
    base = base.join(profile, "c_custkey", "left")
    out = J.windowed_relationship(base, t.events, ["user_id"], "p", "ts", {"value": "value"})
    return out.drop("c_custkey", "user_id", "p")
