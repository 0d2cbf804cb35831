"""Projections, filters and scalar expressions."""

from pyspark.sql import functions as F

from tabloom.functions import dates as D, scalars as S
from tabloom.operators import order as O
from tabloom.plans.fixtures import V_POINTS, V_PROBS, V_TRIPLES
from tabloom.plans.registry import query


@query("F01_select_drop", "select o_orderkey, o_custkey from orders")
def f01(t):
    return t.orders.drop("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("F02_select_matching", "select l_orderkey, l_partkey, l_suppkey from lineitem")
def f02(t):
    return S.select_matching(t.lineitem, "key$", numeric=True)


@query("F03_rename_prefix", "select n_nationkey, n_name as nation_name, n_regionkey as nation_region from nation")
def f03(t):
    df = t.nation.withColumnsRenamed({"n_name": "name", "n_regionkey": "region"})
    return S.add_prefix(df, "nation_", keep=["n_nationkey"])


@query("F04_sanitize_names", "select r_regionkey as region_key, r_name as _blank from region")
def f04(t):
    return S.sanitize_names(t.region.toDF(" region-key ", " "))


@query(
    "F05_predicates_in",
    """select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('P')
    and o_totalprice between 1000 and 300000""",
)
def f05(t):
    return t.orders.filter(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P") & F.col("o_totalprice").between(1000, 300000)
    ).select("o_orderkey")


RATIO = "case when l_discount = 0 then null when l_discount >= 0.09 then 'inf'::double else l_quantity / l_discount end"


def ratio(t):
    d = F.col("l_discount")
    return t.lineitem.withColumn("ratio", F.when(d >= 0.09, F.lit(float("inf"))).when(d != 0, F.col("l_quantity") / F.nullif(d, F.lit(0.0))))


@query("F06_finite_filter", f"select count(*) as n, round(sum(r), 3) as total from (select {RATIO} as r from lineitem) where r is not null and r < 'inf'::double", digits=3)
def f06(t):
    return S.finite_rows(ratio(t), ["ratio"]).agg(F.count(F.lit(1)).alias("n"), F.sum("ratio").alias("total"))


@query(
    "F07_downcast",
    """select 'c_custkey' as name, case when max(c_custkey) < 127 then 'tinyint' when max(c_custkey) < 32767 then 'smallint' else 'int' end as type from customer
    union all select 'c_nationkey', 'tinyint' union all select 'c_acctbal', 'float'
    union all select 'c_name', 'string' union all select 'c_mktsegment', 'string'""",
)
def f07(t):
    df = S.downcast(t.customer)
    return t.spark.createDataFrame(df.dtypes, "name string, type string")


@query("F08_make_key", "select o_orderkey, o_orderstatus || '_' || o_custkey || '_' || o_orderpriority as key from orders")
def f08(t):
    return t.orders.select("o_orderkey", S.make_key(t.orders, ["o_orderstatus", "o_custkey", "o_orderpriority"]).alias("key"))


@query(
    "F09_conditional_column",
    """select size_class, count(*) as n from (select case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end
    as size_class from lineitem) group by 1""",
)
def f09(t):
    q = F.col("l_quantity")
    c = F.when(q < 10, "low").when(q < 30, "mid").otherwise("high")
    return t.lineitem.groupBy(c.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F10_value_mapping",
    "select case o_orderstatus when 'F' then 'final' when 'O' then 'open' else o_orderstatus end as status, count(*) as n from orders group by 1",
)
def f10(t):
    return t.orders.groupBy(S.map_values(F.col("o_orderstatus"), {"F": "final", "O": "open"}).alias("status")).agg(F.count(F.lit(1)).alias("n"))


HOLES = """holes as (select l_orderkey, case when l_linenumber % 3 = 0 then null else l_quantity end as q,
    case when l_linenumber % 4 = 0 then null else l_extendedprice end as x,
    case when l_linenumber % 5 = 0 then null else l_discount end as d from lineitem)"""


def holes(t):
    def hole(k, c):
        return F.when(F.col("l_linenumber") % k != 0, F.col(c))

    return t.lineitem.select("l_orderkey", hole(3, "l_quantity").alias("q"), hole(4, "l_extendedprice").alias("x"), hole(5, "l_discount").alias("d"))


@query(
    "F11_impute",
    f"""with {HOLES} select l_orderkey, round(coalesce(q, (select avg(q) from holes)), 6) as q,
    round(coalesce(x, (select median(x) from holes)), 6) as x, coalesce(d, 0) as d from holes""",
)
def f11(t):
    return S.impute(holes(t), {"q": "mean", "x": "median", "d": 0.0})


@query(
    "F12_safe_cast",
    """select event_id, try_cast(case when event_id % 7 = 0 then event_type else cast(user_id as varchar) end as double) as number from events""",
)
def f12(t):
    raw = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return t.events.select("event_id", raw.try_cast("double").alias("number"))


@query(
    "F12_failing_tokens",
    "select event_type as token, count(*) as n from events where event_id % 7 = 0 group by 1",
)
def f12b(t):
    raw = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return S.failing_tokens(t.events.select(raw.alias("raw")), "raw")


@query(
    "F13_coalesce_variants",
    f"with {HOLES} select l_orderkey, coalesce(q, x) as q, case when l_orderkey % 2 = 0 then coalesce(q, x) else d end as metric from holes",
)
def f13(t):
    df = S.coalesce_variants(holes(t), {"q": "x"})
    return df.select("l_orderkey", "q", F.when(F.col("l_orderkey") % 2 == 0, F.col("q")).otherwise(F.col("d")).alias("metric"))


@query(
    "F14_string_clean",
    """select p_partkey, upper(trim(p_name)) as shout, string_split(p_name, ' ')[1] as first_word,
    regexp_replace(p_name, '[aeiou]', '', 'g') as no_vowels, regexp_extract(p_brand, '#([0-9]+)', 1) as brand_no,
    length(p_name) as len from part""",
)
def f14(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey",
        F.upper(F.trim(n)).alias("shout"),
        F.split(n, " ")[0].alias("first_word"),
        F.regexp_replace(n, "[aeiou]", "").alias("no_vowels"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_no"),
        F.length(n).cast("long").alias("len"),
    )


NAMES_SQL = "case when p_partkey % 3 = 0 then 'P_FD:' || p_size || '_FDW:-' || p_size || '_Cluster-' || p_type when p_partkey % 3 = 1 then 'P_FD:' || p_size || '_FDW:-' || p_size else 'plain' end"


@query(
    "F15_parse_composite_name",
    """select p_partkey, case when p_partkey % 3 < 2 then cast(p_size as varchar) end as fd,
    case when p_partkey % 3 < 2 then '-' || p_size end as fdw, case when p_partkey % 3 = 0 then p_type else 'all_series' end as cluster from part""",
)
def f15(t):
    name = F.expr(NAMES_SQL)
    parts = t.part.select("p_partkey", name.alias("name")).withColumns(S.parse_composite(F.col("name")))
    return parts.drop("name")


@query(
    "F16_count_occurrences",
    """select doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 as n_th,
    len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) as n_words from documents""",
)
def f16(t):
    return t.documents.select(
        "doc_id",
        S.count_substring(F.col("text"), "th").cast("long").alias("n_th"),
        S.word_count(F.col("text")).cast("long").alias("n_words"),
    )


@query(
    "F17_date_parts",
    """select event_id, minute(ts) as minute, hour(ts) as hour, isodow(ts) - 1 as dow, day(ts) as dom, month(ts) as month,
    weekofyear(ts) as week, dayname(ts) as day_name,
    try_strptime(case when event_id % 9 = 0 then 'bad' else strftime(ts, '%Y/%m/%d') end, '%Y/%m/%d') as parsed from events""",
)
def f17(t):
    text = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.date_format("ts", "yyyy/MM/dd"))
    parts = {k: c.cast("long") if k != "day_name" else c for k, c in D.date_parts(F.col("ts")).items()}
    return t.events.withColumns(parts).withColumn("parsed", D.parse_date(text, "yyyy/MM/dd")).select("event_id", *parts, "parsed")


@query(
    "F18_excel_serial",
    """select event_id, case when s >= 61 then timestamp '1899-12-30' + to_days(floor(s)::int) + to_seconds(round((s - floor(s)) * 86400)::bigint) end as ts_1900,
    timestamp '1904-01-01' + to_days(floor(s)::int) + to_seconds(round((s - floor(s)) * 86400)::bigint) as ts_1904
    from (select event_id, value * 100 + 0.25::double as s from events)""",
)
def f18(t):
    s = F.col("value") * 100 + 0.25
    return t.events.select("event_id", D.excel_serial(s).alias("ts_1900"), D.excel_serial(s, 1).alias("ts_1904"))


@query(
    "F19_business_day_cols",
    """with d as (select distinct o_orderdate::date as d from orders),
    m as (select d, date_trunc('month', d)::date as a, (date_trunc('month', d) + interval 1 month)::date as b from d),
    x as (select d, a, b, unnest(generate_series(a::timestamp, (b - 1)::timestamp, interval 1 day))::date as g from m)
    select d::timestamp as d,
      count(*) filter (where isodow(g) = 6) as num_sats_exist_in_mo_d,
      count(*) filter (where isodow(g) = 6 and g < d) as num_sats_elapsed_in_mo_d,
      count(*) filter (where isodow(g) = 6 and g >= d) as num_sats_remain_in_mo_d,
      count(*) filter (where isodow(g) < 6) as num_bizdays_exist_in_mo_d,
      count(*) filter (where isodow(g) < 6 and g < d) as num_bizdays_elapsed_in_mo_d,
      count(*) filter (where isodow(g) < 6 and g >= d) as num_bizdays_remain_in_mo_d
    from x group by 1""",
)
def f19(t):
    return D.business_day_cols(t.orders.select(F.date_trunc("day", "o_orderdate").alias("d")).distinct(), ["d"])


@query(
    "F20_math_scalars",
    """select event_id, round(ln(value), 6) as ln_v, round(ln(1 + value), 6) as log1p_v, round(exp(-value / 100), 6) as exp_v, round(sqrt(value), 6) as sqrt_v,
    round(abs(value - 50), 6) as abs_v, sign(value - 50)::double as sign_v, round(asinh(value), 6) as asinh_v, least(greatest(value, 10), 90)::double as clip_v,
    round(ln((value / 1000) / (1 - value / 1000)), 6) as logit_v from events""",
)
def f20(t):
    v = F.col("value")
    return t.events.select(
        "event_id",
        F.ln(v).alias("ln_v"),
        F.log1p(v).alias("log1p_v"),
        F.exp(-v / 100).alias("exp_v"),
        F.sqrt(v).alias("sqrt_v"),
        F.abs(v - 50).alias("abs_v"),
        F.signum(v - 50).alias("sign_v"),
        F.asinh(v).alias("asinh_v"),
        S.clip(v, 10.0, 90.0).alias("clip_v"),
        S.logit(v / 1000).alias("logit_v"),
    )


@query(
    "F21_extract_nested",
    """select event_id, (props::json ->> '$.k')::double as k, (doc::json ->> '$.scores[1]')::double as second, (doc::json ->> '$.missing')::double as missing
    from (select *, '{"scores": [' || user_id || ',' || event_id || ']}' as doc from events)""",
)
def f21(t):
    doc = F.concat(F.lit('{"scores": ['), F.col("user_id"), F.lit(","), F.col("event_id"), F.lit("]}"))
    return t.events.select(
        "event_id",
        S.nested(F.col("props"), "$.k").alias("k"),
        S.nested(doc, "$.scores[1]").alias("second"),
        S.nested(doc, "$.missing").alias("missing"),
    )


def pairs(t):
    p = t.scores.select("l_orderkey", "l_partkey", "p", "w", "y")
    return p.withColumn("pv", F.array(F.struct(F.lit("1").alias("label"), F.col("p").alias("value")), F.struct(F.lit("0").alias("label"), (1 - F.col("p")).alias("value"))))


P_SQL = "least(greatest((l_discount * 10 + l_quantity / 50) / 2, 1e-6::double), 1 - 1e-6::double)"


@query(
    "F22_spread_pairs",
    f"select l_orderkey, '1' as label1, round({P_SQL}, 6) as proba1, '0' as label2, round(1 - {P_SQL}, 6) as proba2, null::varchar as label3, null::double as proba3 from lineitem",
)
def f22(t):
    return pairs(t).select("l_orderkey", *S.spread_pairs("pv", 3, "label"))


@query("F23_pick_class_value", f"select l_orderkey, round(1 - {P_SQL}, 6) as p0 from lineitem")
def f23(t):
    return pairs(t).select("l_orderkey", S.pick_class_value(F.col("pv"), "0").alias("p0"))


@query(
    "F24_row_argmax",
    f"""with {V_PROBS} select id, round(greatest(app, text, email), 6) as best,
    case when app = greatest(app, text, email) then 'app' when text = greatest(app, text, email) then 'text' else 'email' end as channel from v_probs""",
)
def f24(t):
    cols = ["app", "text", "email"]
    return t.probs.select("id", F.greatest(*cols).alias("best"), S.row_argmax(cols).alias("channel"))


@query(
    "F25_rank_across_columns",
    f"""with {V_PROBS} select id, (floor((app > text)::int + (email > text)::int + (1 + (app = text)::int + (email = text)::int + 1) / 2.0))::int as rank_text,
    (floor((app > text)::int + (email > text)::int + (1 + (app = text)::int + (email = text)::int + 1) / 2.0)) <= 2 as in_top2 from v_probs""",
)
def f25(t):
    return t.probs.select(
        "id",
        S.row_rank(F.col("text"), ["app", "text", "email"]).alias("rank_text"),
        S.is_in_top_n(F.lit("text"), {"app": "app", "text": "text", "email": "email"}, 2).alias("in_top2"),
    )


@query(
    "F26_likely_categorical",
    " union all ".join(
        f"select '{c}' as \"column\", count(distinct {c}) as n_distinct, count({c}) as n, count(distinct {c}) / count({c}) < 0.05 as categorical from orders"
        for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ),
)
def f26(t):
    return S.likely_categorical(t.orders, ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], 0.05)


@query(
    "F27_messy_numbers_dates",
    """select o_orderkey, round(o_totalprice * 1000, 2)::double as number, o_orderdate + to_hours(o_orderkey % 24) as parsed from orders""",
    digits=2,
)
def f27(t):
    d = F.dayofmonth("o_orderdate")
    suffix = F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")
    at = F.format_string("%02d:00:00", F.col("o_orderkey") % 24)
    text = F.concat(F.date_format("o_orderdate", "MMMM d"), suffix, F.date_format("o_orderdate", " yyyy, "), at)
    return t.orders.select(
        "o_orderkey",
        S.messy_number(F.format_number(F.col("o_totalprice") * 1000, 2)).alias("number"),
        S.ordinal_date(text).alias("parsed"),
    )


@query(
    "F28_classify_rules",
    """select family, count(*) as n from (select case when p_name like '%widget' then 'widget' when p_type like '%O%' then 'o type'
    when p_brand like 'Brand#1%' then 'brand one' else 'Unknown' end as family from part) group by 1""",
)
def f28(t):
    key = F.concat_ws("|", "p_brand", "p_type", "p_name")
    rules = [(r"^Brand#1", "brand one"), (r"\|[^|]*O[^|]*\|", "o type"), (r"widget$", "widget")]
    return t.part.groupBy(S.classify(key, rules, "Unknown").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F29_squash_negatives",
    f"""with {V_TRIPLES}, s as (select project, item, score - 0.05 as score from v_triples)
    select project, item, round(case when score < 0 then score / abs(min(score) over (partition by project)) else score end, 6) as score from s""",
)
def f29(t):
    return S.squash_negatives(t.triples.withColumn("score", F.col("score") - 0.05), "score", ["project"])


@query(
    "F30_parse_interval",
    """select p_brand as feature, p_size as bin, p_size::double as lower, p_size + 1.5::double as upper, round(avg(p_retailprice), 6) as coef,
    round(lead(avg(p_retailprice)) over (partition by p_brand order by p_size), 6) as next_coef from part group by 1, 2""",
)
def f30(t):
    g = t.part.groupBy(F.col("p_brand").alias("feature"), F.col("p_size").alias("bin")).agg(F.avg("p_retailprice").alias("coef"))
    text = F.concat(F.lit("("), F.col("bin"), F.lit(", "), F.col("bin") + F.lit(1.5), F.lit("]"))
    parts = S.parse_interval(text)
    return g.withColumns(parts).withColumn("next_coef", S.lead_value("coef", ["feature"], "bin"))


@query(
    "F31_repair_json",
    """select event_id, case when event_id % 10 = 0 then null else event_type end as kind, case when event_id % 10 = 0 then null else user_id end as who,
    user_id % 100 / 4 as pct, 'part-' || event_id || '.csv' as file from events""",
)
def f31(t):
    printed = F.when(F.col("event_id") % 10 == 0, "").otherwise(
        F.concat(F.lit("{u'kind': u'"), F.col("event_type"), F.lit("', u'who': "), F.col("user_id"), F.lit(", 'none': None}"))
    )
    doc = F.from_json(S.repair_json(printed), "kind string, who long, none string")
    return t.events.select(
        "event_id",
        doc.alias("d"),
        S.percent_number(F.concat((F.col("user_id") % 100 / 4).cast("string"), F.lit("%"))).alias("pct"),
        S.basename(F.concat(F.lit("/data/run/part-"), F.col("event_id"), F.lit(".csv"))).alias("file"),
    ).select("event_id", "d.kind", "d.who", "pct", "file")


@query(
    "F32_extract_params",
    "select p_partkey, p_size::double as ntrees, round(p_retailprice, 2) as rate, 0::double as depth from part",
)
def f32(t):
    text = F.concat(F.lit("XGB; ntrees="), F.col("p_size"), F.lit("; rate="), F.col("p_retailprice"), F.lit("; loss=ls"))
    return t.part.withColumn("m", text).select("p_partkey", *[c.alias(k) for k, c in S.extract_params(F.col("m"), ["ntrees", "rate", "depth"]).items()])


@query(
    "F33_encode_ids",
    """select p_partkey, 'x' || dense_rank() over (order by p_brand) as p_brand, 'x' || dense_rank() over (order by p_name) as p_name from part""",
)
def f33(t):
    return S.encode_ids(t.part.select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"])


@query(
    "F34_calendar_keys",
    """select event_id, 'H' || hour(ts) || 'D' || (dayofweek(ts) + 1) as hour_day, 'H' || hour(ts) || 'M' || month(ts) as hour_month,
    'H' || hour(ts) || 'D' || (dayofweek(ts) + 1) || 'M' || month(ts) as hour_day_month, 'D' || (dayofweek(ts) + 1) || 'M' || month(ts) as day_month from events""",
)
def f34(t):
    return t.events.select("event_id", *[c.alias(k) for k, c in S.calendar_keys(F.col("ts")).items()])
