"""Sources and sinks, exercised on files that Spark writes from the given tables."""

from pyspark.sql import functions as F

from tabloom.plans.registry import query
from tabloom.session import scratch_path
from tabloom.sources import readers as R, writers as W

ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


@query(
    "S01_read_csv",
    "select o_orderkey, o_orderstatus, o_totalprice from orders",
)
def s01(t):
    path = scratch_path(t.spark, "csv")
    W.write_csv(t.orders, path)
    return R.read_csv(t.spark, path, ORDERS_SCHEMA, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("S02_compressed_csv", "select doc_id, text, lang, n_chars from documents")
def s02(t):
    path = scratch_path(t.spark, "gz")
    df = t.documents.select("doc_id", "text", "lang", "n_chars")
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("compression", "gzip").csv(path)
    return R.read_csv(t.spark, path, df.schema, ["doc_id", "text", "lang", "n_chars"], multi_line=True)


@query("S03_multichar_delimiter", "select l_orderkey, l_suppkey, l_quantity from lineitem")
def s03(t):
    path = scratch_path(t.spark, "sep")
    W.write_csv(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), path, sep="::")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    return R.read_csv(t.spark, path, schema, ["l_orderkey", "l_suppkey", "l_quantity"], sep="::")


@query(
    "S04_read_jsonl",
    "select event_id, user_id, json_extract(props, '$.k')::bigint as k from events",
)
def s04(t):
    path = scratch_path(t.spark, "jsonl")
    t.events.select("event_id", "user_id", F.from_json("props", "k long").alias("props")).write.json(path)
    return R.read_jsonl(t.spark, path, "event_id long, user_id long, props struct<k: long>").select(
        "event_id", "user_id", F.col("props.k").alias("k")
    )


@query(
    "S05_read_text_lines",
    """with l as (select unnest(string_split(text, chr(10))) as raw from documents),
    c as (select trim(regexp_replace(raw, '[0-9]+', '', 'g'), ' ') as line from l)
    select line, count(*) as n from c where line <> '' group by 1""",
)
def s05(t):
    path = scratch_path(t.spark, "lines")
    t.documents.select("text").write.option("lineSep", "\n").text(path)
    lines = R.read_text_lines(t.spark, path, "[0-9]+")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S06_read_xml_events",
    """select o_orderkey, cast(l_linenumber as varchar) as num, cast(l_partkey as varchar) as part, '' as zone
    from orders join lineitem on l_orderkey = o_orderkey""",
)
def s06(t):
    """Nested XML: an order element with pitch-like children; the absent attribute becomes ''."""
    path = scratch_path(t.spark, "xml")
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("_num"), F.col("l_partkey").alias("_part"))).alias("line")
    )
    t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("_key"), "line"
    ).write.format("xml").option("rowTag", "order").option("rootTag", "orders").save(path)
    rows = R.read_xml_rows(
        t.spark, path, "order", "_key long, line array<struct<_num: long, _part: long, _zone: string>>"
    ).withColumnRenamed("_key", "o_orderkey")
    return R.explode_children(rows, "line", ["o_orderkey"], ["num", "part", "zone"])


@query(
    "S07_read_warehouse",
    """select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders
    where o_totalprice >= 1000.0 group by 1""",
    digits=2,
)
def s07(t):
    return R.read_warehouse(
        t.spark,
        "select o_orderstatus, count(*) as n, sum(o_totalprice) as total from wh_orders where o_totalprice >= :floor group by 1",
        {"wh_orders": t.orders},
        floor=1000.0,
    )


@query(
    "S08_read_union",
    """select 'customer' as source, c_nationkey as nationkey, c_acctbal as acctbal from customer
    union all select 'supplier', s_nationkey, s_acctbal from supplier""",
)
def s08(t):
    base = scratch_path(t.spark, "union")
    for name, df, p in (("customer", t.customer, "c_"), ("supplier", t.supplier, "s_")):
        cols = {c: c.removeprefix(p) for c in df.columns}
        df.withColumnsRenamed(cols).write.parquet(f"{base}/{name}")
    tagged = R.read_tagged_files(t.spark, [f"{base}/customer", f"{base}/supplier"])
    return tagged.select("source", "nationkey", "acctbal")


@query(
    "S08_union_common_columns",
    """select 'customer' as source, c_nationkey as nationkey, c_acctbal as acctbal from customer
    union all select 'supplier', s_nationkey, s_acctbal from supplier""",
)
def s08b(t):
    frames = {
        name: df.select([F.col(c).alias(c.removeprefix(p)) for c in df.columns]).drop("name", "custkey")
        for name, df, p in (("customer", t.customer, "c_"), ("supplier", t.supplier, "s_"))
    }
    return R.read_union(frames)


@query(
    "S09_inline_table",
    """with v(status, label) as (values ('F', 'final'), ('O', 'open'), ('P', 'partial'))
    select label, count(*) as n from orders join v on status = o_orderstatus group by 1""",
)
def s09(t):
    v = R.inline_table(t.spark, [("F", "final"), ("O", "open"), ("P", "partial")], "status string, label string")
    return t.orders.join(F.broadcast(v), F.col("status") == F.col("o_orderstatus")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


TOKENS_SQL = """with v as (select event_id, case event_id % 11 when 0 then 'NA' when 1 then '?' when 2 then ' ' when 3 then '#N/A'
      when 4 then 'Inf' when 5 then '-INF' when 6 then '-1.#IND' when 7 then 'text' else cast(value as varchar) end as raw
    from events)"""


def tokens(t):
    k = F.col("event_id") % 11
    raw = F.col("value").cast("string")
    for i, s in enumerate(("NA", "?", " ", "#N/A", "Inf", "-INF", "-1.#IND", "text")):
        raw = F.when(k == i, s).otherwise(raw)
    return t.events.select("event_id", raw.alias("raw"))


@query(
    "S10_nullify_tokens",
    TOKENS_SQL
    + """ select event_id, case when trim(lower(raw)) in ('', '?', 'na', '#n/a', '-1.#ind') then null else raw end as clean,
      case when lower(raw) = 'inf' then 'inf'::double when lower(raw) = '-inf' then '-inf'::double
        else round(try_cast(raw as double), 6) end as number from v""",
)
def s10(t):
    df = tokens(t).withColumn("number", R.to_number(F.col("raw")))
    return R.nullify_tokens(df, ["raw"]).withColumnRenamed("raw", "clean")


@query("S11_write_table", "select count(*) as rows_written, count(distinct n_regionkey) as regions from nation")
def s11(t):
    path = scratch_path(t.spark, "table")
    name = "tabloom_nation"
    n = W.write_table(t.nation, name, path=path)
    return t.spark.table(name).agg(F.lit(n).cast("long").alias("rows_written"), F.count_distinct("n_regionkey").alias("regions"))


@query(
    "S12_write_parquet",
    "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F'",
)
def s12(t):
    """Partitioned parquet; the status filter prunes folders on the way back."""
    path = scratch_path(t.spark, "parquet")
    W.write_parquet(t.orders, path, ["o_orderstatus"])
    return t.spark.read.parquet(path).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@query("S13_write_split", "select count(*) as n, 1 as within_bound from lineitem")
def s13(t):
    path = scratch_path(t.spark, "split")
    W.write_split(t.lineitem, path, 5000)
    per_file = t.spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("k"))
    return per_file.agg(F.sum("k").alias("n"), F.min(F.when(F.col("k") <= 5000, 1).otherwise(0)).alias("within_bound"))


@query(
    "S14_write_column_chunks",
    "select p_partkey, p_name, p_size from part",
)
def s14(t):
    paths = W.write_column_chunks(t.part, scratch_path(t.spark, "chunks"), ["p_partkey"], 2)
    return (
        t.spark.read.parquet(paths[0]).select("p_partkey", "p_name")
        .join(t.spark.read.parquet(paths[0]).select("p_partkey", F.col("p_type").alias("_t")), "p_partkey")
        .join(t.spark.read.parquet(paths[1]).select("p_partkey", "p_brand", "p_size"), "p_partkey")
        .select("p_partkey", "p_name", "p_size")
    )


@query(
    "S15_write_formatted_text",
    """select (case when toxic = 1 then -1 else 1 end)::varchar || ' |t ' ||
      replace(replace(replace(replace(text, ':', ' '), '|', ' '), chr(10), chr(9)), '\\n', chr(9)) as line
    from documents join labels using (doc_id)""",
)
def s15(t):
    df = t.documents.join(t.labels, "doc_id").select(F.when(F.col("toxic") == 1, -1).otherwise(1).alias("label"), "text")
    path = scratch_path(t.spark, "vw")
    W.write_formatted_text(df, path, "label", "text")
    return t.spark.read.text(path).select(F.col("value").alias("line"))
