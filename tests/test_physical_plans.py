"""The physical plans the jobs rely on."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from ledgersight.catalog import QUERIES
from ledgersight.catalog.registry import Tables
from ledgersight.operators import late, periods, priors, skew
from ledgersight.operators.history import HistoryColumns, history_features
from ledgersight.plans.velocity import velocity
from tests.conftest import BASE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_ids(text):
    return re.sub(r"#\d+L?", "", text)


def test_velocity_shuffles_once(tables):
    text = plan(velocity(tables.log(), amount="amt", hot=None))
    assert text.count("Exchange") == 1
    assert "hashpartitioning(customer_id" in text
    assert text.count("Sort [") == 4


def test_history_shuffles_once(tables):
    text = plan(history_features(tables.log(), HistoryColumns(mcc="mcc_code"), hot=None))
    assert text.count("Exchange") == 1


def test_priors_are_broadcast(tables):
    df = tables.period_log()
    tables_ = priors.fit(priors.fit_rows(df), None, ["mcc_code", "event_desc"])
    text = plan(priors.apply(tables.log(), tables_))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_date_bound_reaches_the_scan(tables):
    text = plan(periods.since(tables.log(), "2024-01-15").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text or "DataFilters: [isnotnull(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_text_bound_is_pushed_down(spark, tables, tmp_path):
    tables.raw().drop("event_ts").write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    text = plan(periods.since_text(raw, "2024-01-15 00:00:00").select("event_id"))
    assert "GreaterThanOrEqual(event_dttm,2024-01-15 00:00:00)" in text


@pytest.mark.parametrize("name", ["job_velocity_features", "job_full_feature_table", "ml_13_blend_search",
                                  "job_scored_rows", "agg_14_histograms"])
def test_no_python_in_the_plan_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, BASE))
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns[0] == "event_id" and df.count() == 1000
    assert set(e.oracle_sql()) <= set(e.queries())


def test_full_job_shuffles_wide_columns_only_of_kept_rows(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        text = plan(QUERIES["job_full_feature_table"](spark, BASE))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # the projection below the shuffle of the windows
    below = next(b for a, b in itertools.pairwise(text.split("\n")) if "REPARTITION_BY_COL" in a)
    plain, folded = below.split("CASE WHEN (is_train_sample", 1)
    for name in ("currency_iso_cd", "battery_pct", "screen_w", "timezone"):
        assert f"{name}#" in folded and f"{name}#" not in plain


def test_folded_columns_return_for_kept_rows(spark):
    rows = spark.createDataFrame([(1, 5, "a", None), (1, 5, "b", 2.0), (None, 6, None, 3.0)], "id bigint, at int, x string, y double")
    narrow = late.fold(rows, ["id", "at", "absent"], F.col("at") < 6)
    assert narrow.columns == ["id", "at", late.FOLDED]
    got = sorted(map(tuple, late.unfold(narrow).collect()), key=str)
    assert got == [(1, 5, "a", None), (1, 5, "b", 2.0), (None, 6, None, None)]
    assert late.unfold(late.fold(rows, rows.columns, F.lit(True))).columns == rows.columns


def test_history_tasks_do_not_grow_with_the_log(tables, monkeypatch):
    """Partitions follow from the rows, on the plain route and for slices and their opening rows."""
    monkeypatch.setattr(skew, "TASK_ROWS", 25)
    rows = tables.log().count()
    columns = HistoryColumns(mcc="mcc_code")
    assert f"hashpartitioning(customer_id, {rows // 25})" in no_ids(plan(history_features(tables.log(), columns, hot=None)))
    low = skew.SkewPolicy(hot_rows=5)
    heavy = skew.split_hot(tables.log(), skew.hot_keys(tables.log(), "customer_id", low), "customer_id")[1].count()
    text = no_ids(plan(history_features(tables.log(), columns, policy=low)))
    assert f"hashpartitioning(customer_id, _cell, {-(-2 * heavy // 25)})" in text
    assert text.count(f"{-(-heavy // 25)}), REPARTITION_BY_NUM") >= 7
