"""Plan hazards: tasks that see everything, rows that pass through Python, missed pruning."""

import re

import pytest

from harness import staging
from harness.compare import compare
from harness.oracles import ORACLES
from harness.queries import QUERIES
from orderledger.operators import cleaning, reports, rules
from orderledger.sources import number_file_records, stage_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql_and_has_a_sound_plan(spark, name):
    df = QUERIES[name](spark, SF)
    assert compare(spark, SF, name, lambda *_: df, ORACLES[name]) is None
    text = df._jdf.queryExecution().toString()
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert node not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A window without PARTITION BY runs in one task.
    assert not re.search(r"Window \[.*\], \[\], ", text)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_orders_by_region", "q_units_by_product", "q_sales_totals", "q_top_region"])
def test_sales_queries_join_all_their_tables_and_read_only_needed_columns(spark, name):
    text = executed(QUERIES[name](spark, SF))
    read = set(re.findall(r"ReadSchema: struct<([a-z]+_)[^>]*>", text))
    assert read == {"l_", "o_", "c_", "n_", "r_", "p_"}
    [lineitem] = set(re.findall(r"ReadSchema: struct<(l_[^>]*)>", text))
    assert "l_tax" not in lineitem and "l_shipdate" not in lineitem


def test_grouping_uses_partial_hash_aggregates(spark):
    clean = stage_table(staging.sales(spark, SF), "test-sales")
    text = executed(reports.sales_breakdown(clean, "order_id"))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "partial_sum" in text
    # The rows are summed per cell before the grouping sets expand them.
    assert text.index("Expand") < text.index("partial_sum(order_value")


def test_the_profile_hashes_the_rows_and_sorts_only_counts(spark):
    raw = stage_table(staging.raw_orders(spark, SF), "test-raw")
    text = executed(rules.region_profile(raw))
    final = text[: text.index("Initial Plan")]
    rows_side = final[final.rindex("Exchange hashpartitioning(region"):]
    assert "HashAggregate" in rows_side
    assert "partial_count(1)" in rows_side.split("Exchange hashpartitioning(region")[-1]


def test_row_checks_are_one_narrow_generated_pass(spark):
    raw = stage_table(staging.raw_orders(spark, SF), "test-raw")
    for frame in (cleaning.clean_orders(raw), cleaning.rejected_orders(raw), rules.order_issues(raw)):
        text = executed(frame)
        assert "Exchange" not in text
        assert re.search(r"\*\(1\) Project", text)


def test_cheap_filters_run_before_title_case(spark):
    raw = stage_table(staging.raw_orders(spark, SF), "test-raw")
    text = executed(cleaning.clean_orders(raw))
    [condition] = re.findall(r"Filter (.*)", text)[:1]
    assert "initcap" not in condition


def test_numbering_moves_no_rows(spark, tmp_path):
    staging.raw_orders(spark, SF).drop("row_number").write.csv(str(tmp_path / "raw"), header=True)
    numbered = number_file_records(spark.read.csv(str(tmp_path / "raw"), header=True))
    text = executed(numbered)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
