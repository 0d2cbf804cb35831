"""User-function surfaces."""

import pandas as pd
from pyspark.sql import functions as F

from tabloom.functions import udfs as U
from tabloom.operators import decisions as D
from tabloom.plans.fixtures import V_SCORES, V_SERIES
from tabloom.plans.registry import query


@query("D01_row_function", "select event_id, round(value * 2 + length(event_type), 6) as out from events")
def d01(t):
    f = U.row_function(lambda v, e: v * 2 + e.str.len(), "double")
    return t.events.select("event_id", f("value", "event_type").alias("out"))


@query(
    "D02_grouped_map",
    f"with {V_SERIES} select series_id, date, round(target - median(target) over (partition by series_id), 6) + 0 as out from v_series",
)
def d02(t):
    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(out=pdf.target - pdf.target.median())[["series_id", "date", "out"]]

    return U.grouped_map(t.series, ["series_id"], centre, "series_id string, date timestamp, out double")


@query("D03_aggregate_function", f"with {V_SERIES} select series_id, round(max(target) - min(target), 6) as spread from v_series group by 1")
def d03(t):
    spread = U.aggregate_function(lambda v: float(v.max() - v.min()))
    return t.series.groupBy("series_id").agg(spread("target").alias("spread"))


@query("D04_table_generating", "select o_orderkey, 'half' as kind, o_totalprice / 2 as v from orders union all select o_orderkey, 'key', o_custkey from orders", digits=6)
def d04(t):
    rows = F.array(
        F.struct(F.lit("half").alias("kind"), (F.col("o_totalprice") / 2).alias("v")),
        F.struct(F.lit("key").alias("kind"), F.col("o_custkey").cast("double").alias("v")),
    )
    return U.generate(t.orders, ["o_orderkey"], rows)


@query("D05_fit_transform", "select p_partkey, round(p_retailprice - (select median(p_retailprice) from part), 6) + 0 as price, p_size - (select median(p_size) from part) as size from part")
def d05(t):
    x = t.part.select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    m = U.MedianCentre(inputCols=["p_retailprice", "p_size"], outputCols=["price", "size"]).fit(x)
    return m.transform(x).select("p_partkey", "price", "size")


@query(
    "D06_objective_callable",
    f"""with {V_SCORES}, d as (select p, sum(y)::double as pos, sum(1 - y)::double as neg from v_scores group by 1), r as (select p as threshold, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as a, sum(neg) over () as b from d window w as (order by p desc))
    select round(threshold, 6) as threshold, round(tp / a - fp / b, 6) as objective from r order by tp / a - fp / b desc, threshold desc limit 1""",
)
def d06(t):
    """Youden index as a user objective over the ROC points."""
    best = D.best_threshold(D.roc_points(t.scores, "y", "p"), lambda: F.col("tpr") - F.col("fpr"))
    return best.select("threshold", "objective")
