"""Streaming jobs run over the whole events table with AvailableNow and read back."""

from pyspark.sql import functions as F

from tabloom.functions import metrics as M
from tabloom.plans.registry import query
from tabloom.session import scratch_path
from tabloom.streaming import jobs as J, keyed as K


def N():
    return F.count(F.lit(1))


def stream(t):
    """The events table as a stream, whether it is one file or a folder of files."""
    if t.events.inputFiles()[0].endswith("/events.parquet"):
        return J.file_stream(t.spark, t.dir, t.events.schema, names="events.parquet")
    return J.file_stream(t.spark, f"{t.dir}/events.parquet", t.events.schema)


def shuffled(t, files=5):
    """The events in files that follow no order of time, one file a micro-batch."""
    path = scratch_path(t.spark, "arrivals")
    t.events.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    return J.file_stream(t.spark, path, t.events.schema, max_files=1)


def landed(t, df, mode="append", **kw):
    path = scratch_path(t.spark, "stream")
    J.run_to_table(df, t.spark, path, mode, **kw)
    return t.spark.read.parquet(path)


BUCKET = "time_bucket(interval 12 hours, ts, timestamp '1970-01-01')"


SERVICE = f"""select {BUCKET} as start, {BUCKET} + interval 12 hours as "end", event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from events group by 1, 2, 3"""


@query("R01_service_stats", SERVICE)
def r01(t):
    return K.window_stats(stream(t), "ts", ["event_type"], K.service("value"), "12 hours")


@query("R01_out_of_order", SERVICE)
def r01c(t):
    return K.window_stats(shuffled(t), "ts", ["event_type"], K.service("value"), "12 hours")


@query(
    "R01_expanding_stats",
    f"""with b as (select event_type, {BUCKET} as start, count(*) as n, sum(value) as s from events group by 1, 2)
    select event_type, start, (sum(n) over w)::bigint as n, round(sum(s) over w / sum(n) over w, 6) as mean_value from b window w as (partition by event_type order by start)""",
)
def r01b(t):
    return J.expanding_stats(t.events, "ts", ["event_type"], "value")


@query(
    "R02_sliding_stats",
    """with o as (select unnest(range(4)) as k), s as (select time_bucket(interval 3 hours, ts, timestamp '1970-01-01') - to_hours((3 * k)::int) as start, event_type, value from events, o)
    select start, start + interval 12 hours as "end", event_type, count(*) as n, round(avg(value), 6) as mean_value, max(value) as max_value from s group by 1, 2, 3""",
)
def r02(t):
    return K.window_stats(stream(t), "ts", ["event_type"], K.service("value"), "12 hours", "3 hours")


SESSIONS = (
    """with e as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minutes then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select min(ts) as start, max(ts) + interval 30 minutes as "end", user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, k"""
)


@query("R02_session_stats", SESSIONS, digits=4)
def r02b(t):
    return K.session_stats(stream(t), "ts", ["user_id"], "value", "30 minutes")


@query("R02_sessions_out_of_order", SESSIONS, digits=4)
def r02c(t):
    """Sessions that several batches have a part in are joined."""
    return K.session_stats(shuffled(t), "ts", ["user_id"], "value", "30 minutes")


LATE = """select p.event_id, p.user_id, p.ts as pred_ts, p.value as prediction, a.ts as actual_ts, a.value as actual from events p left join events a on a.event_type = 'purchase' and a.user_id = p.user_id
    and a.ts >= p.ts and a.ts <= p.ts + interval 2 days where p.event_type in ('view', 'click')"""


def predictions(df):
    return df.filter("event_type in ('view', 'click')").select("event_id", "user_id", F.col("ts").alias("pred_ts"), F.col("value").alias("prediction"))


def purchases(df):
    return df.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("actual_ts"), F.col("value").alias("actual"))


@query("R03_late_actuals_join", LATE)
def r03(t):
    return K.late_actuals(predictions(stream(t)), purchases(stream(t)), "user_id", "pred_ts", "actual_ts", 2)


@query("R03_late_out_of_order", LATE)
def r03d(t):
    """Predictions and actuals in any order, a file at a time."""
    s = shuffled(t)
    return K.late_actuals(predictions(s), purchases(s), "user_id", "pred_ts", "actual_ts", 2)


@query(
    "R03_late_actuals_inner",
    """select p.event_id, p.user_id, p.ts as pred_ts, p.value as prediction, a.ts as actual_ts, a.value as actual from events p join events a on a.event_type = 'purchase' and a.user_id = p.user_id
    and a.ts >= p.ts and a.ts <= p.ts + interval 2 days where p.event_type in ('view', 'click')""",
)
def r03c(t):
    """The matches alone."""
    return K.late_actuals(predictions(stream(t)), purchases(stream(t)), "user_id", "pred_ts", "actual_ts", 2).where("actual_ts is not null")


@query(
    "R03_late_actuals_batch",
    LATE,
)
def r03b(t):
    preds = predictions(t.events)
    return J.late_actuals_join(preds, purchases(t.events), "user_id", "pred_ts", "actual_ts", "2 days")


@query(
    "R04_rolling_accuracy",
    """with d as (select ts, value as actual, (props::json ->> '$.k')::double as pred from events) select date_trunc('day', ts)::timestamp as start, count(*) as n, round(sqrt(avg((actual - pred) ** 2)), 6) as value, 40.0::double as baseline,
    round(100 * (sqrt(avg((actual - pred) ** 2)) - 40) / 40, 6) + 0 as pct_change from d group by 1""",
)
def r04(t):
    j = stream(t).withColumn("pred", F.get_json_object("props", "$.k").cast("double"))
    return K.window_stats(j, "ts", [], K.accuracy(F.col("value"), F.col("pred"), 40.0), "1 day").drop("end")


@query(
    "R05_drift",
    """with ref as (select value from events where event_type = 'view'), e as (select quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) as e from ref), b as (select date_trunc('day', ts)::timestamp as start, len(list_filter(e, lambda x: value > x)) as b from events, e where event_type <> 'view'),
    rb as (select len(list_filter(e, lambda x: value > x)) as b, count(*) / (select count(*) from ref) as share from ref, e group by 1), g as (select d.start, rb.b, rb.share, (select count(*) from b where b.start = d.start and b.b = rb.b) as k,
      (select count(*) from b where b.start = d.start) as n from (select distinct start from b) d, rb)
    select start, n, round(sum((greatest(k / n, 1e-6) - share) * ln(greatest(k / n, 1e-6) / share)), 6) as psi from g group by 1, 2""",
)
def r05(t):
    edges, shares = J.reference_bins(t.events.filter("event_type = 'view'"), "value", 5)
    return K.drift_many(stream(t).filter("event_type <> 'view'"), "ts", {"value": edges}, {"value": shares}).drop("feature")


def _psi_sql(feature, value, probs="[0.2, 0.4, 0.6, 0.8]"):
    """Drift of one column, as in R05_drift."""
    return f"""select '{feature}' as feature, start, n, round(sum((greatest(k / n, 1e-6) - greatest(share, 1e-6)) * ln(greatest(k / n, 1e-6) / greatest(share, 1e-6))), 6) as psi from (
      with x as (select event_type, ts, {value} as v from events), ref as (select v from x where event_type = 'view' and v is not null), e as (select list_distinct(quantile_cont(v, {probs})) as e from ref),
      bins as (select unnest(range(len(e) + 1)) as b from e), rb as (select b, (select count(*) from ref, e where len(list_filter(e, lambda y: v > y)) = b) / (select count(*) from ref) as share from bins),
      d as (select date_trunc('day', ts)::timestamp as start, len(list_filter(e, lambda y: v > y)) as b from x, e where event_type <> 'view' and v is not null),
      s as (select start, count(*) as n from d group by 1) select s.start, s.n, rb.share, (select count(*) from d where d.start = s.start and d.b = rb.b) as k from s, rb) group by start, n"""


@query("R05_drift_columns", " union all ".join(_psi_sql(f, v) for f, v in (("k", "(props::json ->> '$.k')::double"), ("user_id", "user_id::double"), ("target", "value"))))
def r05b(t):
    """Two features and the target in one job."""
    wide = lambda df: df.select("ts", "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("user_id"), F.col("value").alias("target"))
    ref = wide(t.events.filter("event_type = 'view'"))
    bins = {c: J.reference_bins(ref, c, 5) for c in ("k", "user_id", "target")}
    return K.drift_many(wide(stream(t).filter("event_type <> 'view'")), "ts", {c: e for c, (e, _) in bins.items()}, {c: s for c, (_, s) in bins.items()})


@query("R06_first_seen", "select user_id, min(ts) as first from events group by 1")
def r06(t):
    return K.first_seen(stream(t), "user_id", "ts")


@query("R06_first_seen_out_of_order", "select user_id, min(ts) as first from events group by 1")
def r06b(t):
    """State that forgets at once, and rows in any order."""
    return K.first_seen(shuffled(t), "user_id", "ts", keep_ms=1)


@query("R07_dedup_stream", "select event_id, ts, 1 as copy from events")
def r07(t):
    """Every event twice, its copies in different batches."""
    s = shuffled(t)
    twice = s.select("event_id", "ts", F.lit(1).alias("copy")).unionByName(shuffled(t, 3).select("event_id", "ts", F.lit(2).alias("copy")))
    return K.deduplicated(twice, ["event_id"])


@query("R08_daily_incremental", "select ts::date as day, count(*) as n, round(sum(value), 4) as total from events group by 1", digits=4)
def r08(t):
    """Two scheduled runs over one folder: the second picks up only what arrived after the first."""
    source, target, state = [scratch_path(t.spark, x) for x in ("arrivals", "daily", "progress")]
    for k in (0, 1):
        t.events.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(source)
        J.daily_incremental(t.spark, source, t.events.schema, target, "ts", state)
    return t.spark.read.parquet(target).groupBy("day").agg(N().alias("n"), F.sum("value").alias("total"))


@query("R09_score_stream", "select event_id, round(ln(1 + value) + length(event_type), 6) as score from events")
def r09(t):
    path = scratch_path(t.spark, "scored")
    J.score_stream(stream(t), lambda d: d.select("event_id", (F.log1p("value") + F.length("event_type")).alias("score")), t.spark, path)
    return t.spark.read.parquet(path)
