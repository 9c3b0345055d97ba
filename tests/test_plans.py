"""The physical plans say what the operators promise."""

import pytest
from pyspark.sql import functions as F

from datascry.operators import filters as f
from datascry.operators import profile as p
from datascry.operators import timeseries as ts
from datascry.operators.cleaning import fit_cleaner
from datascry.operators.merge import merge
from datascry.operators.sampling import split_train_test, top_k


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "rows")
    spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.rand(1).alias("v"), F.rand(2).alias("w"),
                             F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id % 900 as int))").alias("ts")).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(rows):
    text = plan(f.remove_less_than(f.time_range(rows, "ts", "2026-03-01"), "v", 0.5).select("id"))
    assert "GreaterThanOrEqual(ts" in text and "GreaterThanOrEqual(v,0.5)" in text
    assert "w:double" not in text
    text = plan(f.year_filter(rows, "ts", 2027))
    assert "GreaterThanOrEqual(ts,2027-01-01" in text and "LessThan(ts,2028-01-01" in text


def test_fitted_cleaning_and_splits_do_not_shuffle(rows):
    model = fit_cleaner(rows, [{"column": "v", "actionType": a} for a in ("impute_mean", "clip_outliers", "transform_log")])
    assert "Exchange" not in plan(split_train_test(model.transform(rows, training=True), "id"))


def test_window_per_key_shuffles_once(rows):
    assert plan(ts.lag_features(rows, ["k"], "ts", "v", tie="id")).count("Exchange ") == 1


def test_top_k_per_group_prunes_before_the_shuffle(rows):
    text = plan(top_k(rows, "v", 3, by=["k"], ties=["id"]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_no_cross_joins(rows):
    other = rows.select("id", F.col("v").alias("x"))
    for df in (merge(rows, other, "id", "id", "outer"), p.histogram(rows, "v", by=["k"]), p.profile(rows, by=["k"])):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
