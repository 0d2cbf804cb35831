"""Registered queries against their SQL twins.

By default a spread of queries runs on the smallest tables; TABLOOM_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabloom.plans.fixtures import NAMES

SF = os.environ.get("TABLOOM_SF", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "S04_read_jsonl", "S10_nullify_tokens", "F11_impute", "F19_business_day_cols", "F33_encode_ids", "J09_asof_backward", "J10_rolling_join",
    "J13_radius_counts", "J21_relationships", "A13_pairwise_correlation", "A16_exact_percentile", "A20_weighted_qcut", "A28_describe_by",
    "W05_rolling_mode", "W09_last_k_items", "W14_fills", "O08_stratified_partition", "O10_time_split", "U04_table_diff", "T00_quality_run",
    "T18_holiday_calendar", "T20_event_distance", "M05_auc", "M21_fve", "M27_gini_20_bins", "M29_metrics_report", "K09_woe_iv", "I12_attribution",
    "I27_kaplan_meier", "I29_meta_recommend", "X06_tfidf", "X13_nearest_vectors", "R02_session_stats", "D06_objective_callable",
]
RUN = sorted(SQL) if os.environ.get("TABLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(str([r[i] for i in order]) for r in rows)


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 300
    assert set(SAMPLE) <= set(SQL)


@pytest.mark.parametrize("name", RUN)
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, df.collect()) == canonical(cols, cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
