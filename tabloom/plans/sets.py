"""Set operations."""

from pyspark.sql import functions as F

from tabloom.operators import sets as U
from tabloom.plans.registry import query


def N():
    return F.count(F.lit(1))


@query(
    "U01_union_fill",
    """select c_custkey as id, c_acctbal as bal, c_mktsegment as segment, null as name from customer
    union all select s_suppkey, s_acctbal, null, s_name from supplier""",
)
def u01(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return U.union_fill([a, b])


@query("U02_distinct", "select distinct p_brand, p_type, p_size from part")
def u02(t):
    return t.part.select("p_brand", "p_type", "p_size").distinct()


@query(
    "U03_keep_latest",
    "select o_custkey, o_orderkey, o_orderdate from orders qualify o_orderdate = max(o_orderdate) over (partition by o_custkey)",
)
def u03(t):
    return U.keep_latest(t.orders, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "U04_table_diff",
    """with b as (select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus,
      case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, 1 as extra from orders where o_orderkey % 3 <> 1)
    select 'o_orderstatus' as "column", 0::bigint as missing_a, 0::bigint as missing_b, (select count(*) from b where o_orderstatus = 'X') as differ, 'both' as place
    union all select 'o_totalprice', 0, (select count(*) from b where o_totalprice is null), (select count(*) from b where o_totalprice is null), 'both'
    union all select 'o_custkey', null, null, null, 'a' union all select 'extra', null, null, null, 'b'""",
)
def u04(t):
    k = F.col("o_orderkey")
    a = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    b = t.orders.filter(k % 3 != 1).select(
        "o_orderkey",
        F.when(k % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.lit(1).alias("extra"),
    )
    return U.table_diff(a, b, ["o_orderkey"])


@query(
    "U05_coldstart",
    """with train as (select distinct o_custkey from orders where o_orderdate < timestamp '1996-01-01')
    select o_orderkey, case when o_custkey in (select o_custkey from train) then 0 else 1 end as weight from orders where o_orderdate >= timestamp '1996-01-01'""",
)
def u05(t):
    cut = F.to_timestamp(F.lit("1996-01-01"))
    train, test = t.orders.filter(F.col("o_orderdate") < cut), t.orders.filter(F.col("o_orderdate") >= cut)
    return U.coldstart_weights(test, train, ["o_custkey"]).select("o_orderkey", "weight")


@query(
    "U05_intersect_except",
    """select 'intersect' as kind, k from (select distinct o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P')
    union all select 'except', k from (select o_custkey as k from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'P')""",
)
def u05b(t):
    f = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    p = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return f.intersect(p).select(F.lit("intersect").alias("kind"), "k").unionByName(f.exceptAll(p).select(F.lit("except").alias("kind"), "k"))


@query(
    "U06_mirror_pairs",
    """with g as (select l_orderkey, l_partkey as a, l_quantity as sa, l_suppkey as b, l_linenumber * 10.0::double as sb from lineitem)
    select l_orderkey, a as own_id, sa as own_score, b as opp_id, sb as opp_score, (sa > sb)::int as won, 1 as home from g
    union all select l_orderkey, b, sb, a, sa, (not sa > sb)::int, 0 from g""",
)
def u06(t):
    g = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_quantity").alias("sa"), F.col("l_suppkey").alias("b"), (F.col("l_linenumber") * 10.0).alias("sb"))
    return U.mirror_pairs(g, ["a", "sa"], ["b", "sb"], ["id", "score"], F.col("sa") > F.col("sb"), F.lit(True))


@query(
    "U07_common_keys",
    """select o_custkey, count(*) as n from orders where o_custkey in (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'
    intersect select o_custkey from orders where o_orderstatus = 'P') and o_custkey not in (1, 2, 3) group by 1""",
)
def u07(t):
    frames = [t.orders.filter(F.col("o_orderstatus") == s) for s in "FOP"]
    parts = U.restrict(frames, "o_custkey", [1, 2, 3])
    return U.union_fill(parts).groupBy("o_custkey").agg(N().alias("n"))
