"""Sort, limit, sampling and partitioning."""

from pyspark.sql import functions as F

from tabloom.operators import sampling as S
from tabloom.operators.order import group_transform
from tabloom.plans.fixtures import V_SCORES, V_SERIES
from tabloom.plans.registry import query
from tabloom.session import shuffled
from tabloom.spec import SeriesSpec

SPEC = SeriesSpec()
BRANDS = SeriesSpec("p_brand", "d", "v")


def N():
    return F.count(F.lit(1))


def brand_days(t):
    j = t.lineitem.join(shuffled(t.part), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_brand", F.col("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v"))


V_BD = """v_bd as (select p_brand, l_shipdate as d, sum(l_quantity) as v from lineitem join part on p_partkey = l_partkey group by 1, 2)"""


@query(
    "O01_sort_keys",
    "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority desc nulls last, o_totalprice asc nulls last, o_orderkey",
)
def o01(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        F.desc_nulls_last("o_orderpriority"), F.asc_nulls_last("o_totalprice"), "o_orderkey"
    )


@query("O02_top_k", "select l_suppkey, count(*) as n from lineitem group by 1 order by n desc, 1 limit 10")
def o02(t):
    return t.lineitem.groupBy("l_suppkey").agg(N().alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


@query(
    "O03_top_series",
    f"with {V_BD} select p_brand, count(*) as n from v_bd where p_brand in (select p_brand from v_bd group by 1 order by avg(v) desc, 1 limit 5) group by 1",
)
def o03(t):
    return S.top_series(brand_days(t), BRANDS, 5).groupBy("p_brand").agg(N().alias("n"))


@query(
    "O04_series_by_quantile",
    f"""with {V_BD}, m as (select p_brand, avg(v) as m from v_bd group by 1)
    select p_brand, count(*) as n from v_bd where p_brand in (select p_brand from m where m >= (select quantile_cont(m, 0.75) from m)) group by 1""",
)
def o04(t):
    return S.series_by_quantile(brand_days(t), BRANDS, 0.75).groupBy("p_brand").agg(N().alias("n"))


@query("O05_sample_exact", "select least(500, count(*))::int as n, least(500, count(distinct o_orderkey))::int as distinct_n, least(500, count(o_orderkey))::int as known from orders")
def o05(t):
    s = S.sample_exact(t.orders.select("o_orderkey"), ["o_orderkey"], 500, seed=7)
    return s.agg(N().cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("distinct_n"), F.count("o_orderkey").cast("int").alias("known"))


@query("O05_sample_fraction")
def o05b(t):
    return S.sample_fraction(t.orders, ["o_orderkey"], 0.1, seed=7)


@query(
    "O06_sample_series_target",
    f"with {V_BD} select p_brand, count(*) as n from v_bd where p_brand in (select p_brand from v_bd group by 1 order by avg(v) desc, 1 limit (select (count(distinct p_brand) * 0.4)::int from v_bd)) group by 1",
)
def o06(t):
    return S.sample_series(brand_days(t), BRANDS, 0.4, "target").groupBy("p_brand").agg(N().alias("n"))


@query(
    "O06_sample_series_timespan",
    f"with {V_BD} select p_brand, count(*) as n from v_bd where p_brand in (select p_brand from v_bd group by 1 order by max(d) - min(d) desc, 1 limit (select (count(distinct p_brand) * 0.4)::int from v_bd)) group by 1",
)
def o06b(t):
    return S.sample_series(brand_days(t), BRANDS, 0.4, "timespan").groupBy("p_brand").agg(N().alias("n"))


@query("O06_sample_series_random")
def o06c(t):
    return S.sample_series(brand_days(t), BRANDS, 0.4, "random", seed=3)


@query("O07_sample_groups")
def o07(t):
    return S.sample_groups(t.lineitem, "l_suppkey", 10, seed=3)


@query(
    "O08_stratified_partition",
    """with c as (select o_orderpriority, count(*) as n, floor(count(*) * 0.2 + 0.5)::bigint as h from orders group by 1), f as (select unnest(range(1, 6)) as k)
    select o_orderpriority, 'H' as partition, h as n from c union all select o_orderpriority, 'T' || k, (n - h - k + 5) // 5 from c, f""",
)
def o08(t):
    p = S.stratified_partition(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 5, 0.2, seed=1)
    return p.groupBy("o_orderpriority", "partition").agg(N().alias("n"))


@query("O09_group_split", "select count(*) as pairs, 1 as max_sides from (select distinct o_custkey, o_orderstatus from orders)")
def o09(t):
    s = S.group_split(t.orders, ["o_custkey", "o_orderstatus"], 0.7, seed=2)
    sides = s.select("o_custkey", "o_orderstatus", "split").distinct().groupBy("o_custkey", "o_orderstatus").agg(N().alias("k"))
    return sides.agg(N().alias("pairs"), F.max("k").cast("int").alias("max_sides"))


@query(
    "O10_time_split",
    f"""with {V_SERIES}, p as (select series_id, date, row_number() over (partition by series_id order by date) as pos, count(*) over (partition by series_id) as n from v_series),
    s as (select *, greatest(1, round(n * 0.1 / 7)) * 7 as size from p)
    select series_id, date, case when n - pos < size then 'holdout' when n - pos < 2 * size then 'valid' else 'train' end as part from s""",
)
def o10(t):
    return S.time_split(t.series, SPEC, 0.1, 7).select("series_id", "date", "part")


@query("O10_year_split", "select o_orderkey, case when year(o_orderdate) >= 1999 then 'holdout' when year(o_orderdate) >= 1997 then 'valid' else 'train' end as part from orders where o_orderdate is not null")
def o10b(t):
    return S.year_split(t.orders.where("o_orderdate is not null"), "o_orderdate", 1997, 1999).select("o_orderkey", "part")


@query(
    "O11_block_partition",
    """with p as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as pos from orders)
    select o_orderkey, (['a', 'a', 'b', 'c'])[(pos - 1) % 4 + 1] as partition from p""",
)
def o11(t):
    return S.block_partition(t.orders, ["o_orderdate", "o_orderkey"], ["a", "a", "b", "c"]).select("o_orderkey", "partition")


@query("O12_downsample_majority")
def o12(t):
    return S.downsample_majority(t.scores, "y", 0, ["l_orderkey", "l_partkey", "l_suppkey"], 0.25, seed=5)


#: A draw that SQL repeats: numbers in [0, 1) from keys.
DRAW = "((o_orderkey * 7919 + 13) % 10007) / 10007.0::double"


def draw():
    return ((F.col("o_orderkey") * 7919 + 13) % 10007) / F.lit(10007.0)


@query(
    "O12_downsample_normalised",
    f"""with k as (select *, o_orderstatus <> 'F' or {DRAW} < 0.25 as kept from orders), s as (select count(*) filter (where kept) / count(*) as share from k)
    select o_orderkey, round(share * case when o_orderstatus = 'F' then 4.0::double else 1.0 end, 6) as weight from k, s where kept""",
)
def o12c(t):
    """The pair of weights that adds up to the kept rows."""
    return S.downsample_majority(t.orders, "o_orderstatus", "F", ["o_orderkey"], 0.25, normalise=True, draw=draw()).select("o_orderkey", "weight")


@query(
    "O15_bootstrap_draw",
    f"""with r as (select o_orderkey, o_totalprice, r, ((o_orderkey * 7919 + r * 104729) % 10007) / 10007.0::double as u from orders, (select unnest(range(1, 11)) as r)),
    c as (select *, case {" ".join(f"when u < {c!r} then {i}" for i, c in enumerate(S.POISSON_CUTS))} else {len(S.POISSON_CUTS)} end as copies from r)
    select r::int as replicate, count(*) as rows, sum(copies)::bigint as copies, round(sum(copies * o_totalprice) / sum(copies), 4) as mean_price from c where copies > 0 group by 1""",
    digits=4,
)
def o15b(t):
    """Ten replicates drawn by numbers that SQL repeats."""
    u = ((F.col("o_orderkey") * 7919 + F.col("replicate") * 104729) % 10007) / F.lit(10007.0)
    b = S.bootstrap(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10, draw=u)
    return b.groupBy("replicate").agg(N().alias("rows"), F.sum("copies").cast("long").alias("copies"), (F.sum(F.col("copies") * F.col("o_totalprice")) / F.sum("copies")).alias("mean_price"))


@query(
    "O17_sample_to_size_draw",
    f"""with b as (select avg(octet_length(encode('{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}}'))) * count(*) as b from orders)
    select o_orderkey, o_custkey from orders, b where {DRAW} < least(1.0::double, 10000 / b)""",
)
def o17b(t):
    return S.sample_to_size(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 10_000, probe=1.0, draw=draw())


@query("O13_reweight_to_mean", f"with {V_SCORES} select y, count(*) as n, 0.165 as weighted_mean from v_scores group by 1".replace("0.165", "0.165::double"))
def o13(t):
    w = S.reweight_to_mean(t.scores.select("y"), "y", 0.165)
    m = w.agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("weighted_mean"))
    return w.groupBy("y").agg(N().alias("n")).crossJoin(F.broadcast(m))


@query("O14_shuffle", "select count(*) as n, count(distinct o_orderkey) as keys, sum(o_orderkey)::bigint as total from orders")
def o14(t):
    s = S.shuffle(t.orders.select("o_orderkey"), ["o_orderkey"], seed=4)
    return s.agg(N().alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_orderkey").alias("total"))


@query("O15_bootstrap")
def o15(t):
    b = S.bootstrap(t.events.select("event_id", "value"), ["event_id"], 20, seed=9)
    return b.groupBy("replicate").agg((F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"), F.sum("copies").alias("n"))


@query(
    "O16_chunks",
    """with p as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as pos from orders)
    select (pos - 1) // 1000 as chunk, count(*) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from p group by 1""",
)
def o16(t):
    c = S.chunk_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000)
    return c.groupBy("chunk").agg(N().alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("O17_sample_to_size")
def o17(t):
    return S.sample_to_size(t.documents, ["doc_id"], 500_000, seed=1).select("doc_id", "n_chars")


@query("O07_sample_groups_whole", "select least(10, count(distinct l_suppkey)) as groups, true as complete from lineitem")
def o07b(t):
    """The sampled groups are whole: their row counts equal those of the table."""
    got = S.sample_groups(t.lineitem, "l_suppkey", 10, seed=3).groupBy("l_suppkey").agg(N().alias("a"))
    want = t.lineitem.groupBy("l_suppkey").agg(N().alias("b"))
    return got.join(want, "l_suppkey").agg(N().alias("groups"), F.bool_and(F.col("a") == F.col("b")).alias("complete"))


@query(
    "O12_downsample_weights",
    f"with {V_SCORES} select y, case when y = 0 then 4.0::double else 1.0 end as weight, case when y = 1 then count(*) end as kept, true as near from v_scores group by 1",
)
def o12b(t):
    """Weights per class, all minority rows kept, and the weighted class size near the true one."""
    d = S.downsample_majority(t.scores, "y", 0, ["l_orderkey", "l_partkey", "l_suppkey", "actual"], 0.25, seed=5)
    size = t.scores.groupBy("y").agg(N().alias("all"))
    g = d.groupBy("y", "weight").agg(N().alias("n")).join(size, "y")
    near = F.abs(F.col("n") * F.col("weight") / F.col("all") - 1) < 0.1
    return g.select("y", "weight", F.when(F.col("y") == 1, F.col("n")).alias("kept"), near.alias("near"))
