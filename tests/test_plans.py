"""Plans of the queries: no nested loops, filters at the scan, no exchange that a large table could not bear."""

import re

import pytest

import __spark_entry__ as entry_module
from tiersmith.operators import rows as R

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["row_index", "ranks", "gather_rows", "hconcat", "median_by_task", "abs_stats", "conformal_scale",
                                  "correlations", "tuple_filter_leftover", "mean_pool", "species_pool", "gp_single", "se_kernel_rows",
                                  "cell_membership", "layer_band", "percent_improvement", "method_comparison", "search_study"])
def test_no_nested_loops(spark, monkeypatch, name):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 100)
    text = plan(entry_module.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_range_filter_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(entry_module.queries()["range_filter"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_quantity,10.0\).*LessThan\(l_discount,0.05\)", text)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in text


def test_index_sorts_rows_by_bucket_and_joins_without_another_exchange(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(R.row_index(spark.range(10_000), ["id"], group=None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows_side = text.split("SortMergeJoin")[1].split("Window")[1:]
    assert rows_side and text.count("Exchange hashpartitioning(__b") <= 2
