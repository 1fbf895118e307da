"""What the plans may and may not contain, with broadcasting switched off as for large tables."""

import re

import pytest
from pyspark.sql import functions as F

from cartlens.catalog import CATALOG
from cartlens.plans import marts
from cartlens.sources.stage import stage
from cartlens.sources.testdata import raw_tables
from tests.fixtures import fixed_warehouse

# Windows over a handful of already grouped rows: segments, premium flags, experiment groups.
SMALL_WINDOWS = {"cust_segment_share", "png_premium_share", "png_ab_conversion"}
# The p-value of one result row.
PYTHON = {"ab_chi2"}
# Writes and reads back: the plan shown is only that of the reader.
SINKS = {"write_csv_star", "report_tables", "build_warehouse", "build_all"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(plan: str) -> list[str]:
    """Window lines without a partition list: `Window [expressions], [partition], [order]`."""
    found = []
    for line in plan.splitlines():
        if re.search(r"[+:]- Window \[|\) Window \[", line):
            lists = re.findall(r"\[([^\[\]]*)\]", re.search(r"((?:, \[[^\[\]]*\])*)$", line).group(1))
            if not lists or re.search(r" (ASC|DESC) ", lists[0]):
                found.append(line)
    return found


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(CATALOG) - SINKS))
def test_plan(small_warehouse, name):
    plan = plan_of(CATALOG[name](small_warehouse))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("Python" in plan) == (name in PYTHON)
    assert bool(unpartitioned_windows(plan)) == (name in SMALL_WINDOWS)


def test_fact_scan_reads_only_what_it_needs(small_warehouse):
    plan = plan_of(CATALOG["q01_monthly_revenue"](small_warehouse))
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert {column.split("#")[0] for column in columns.split(",")} == {
        "transaction_id", "month", "net_revenue", "gross_revenue", "refund_flag"}


def test_refund_filter_reaches_the_scan(small_warehouse):
    plan = plan_of(marts.product_tx_agg(small_warehouse.transactions))
    assert re.search(r"PushedFilters: \[[^\]]*Not\(EqualTo\(refund_flag,true\)\)|PushedFilters: \[[^\]]*refund_flag",
                     plan)


def test_distinct_buyers_travel_without_the_sums(small_warehouse):
    plan = plan_of(marts.product_tx_agg(small_warehouse.transactions))
    # One exchange of sums, one of pairs, one of the counted pairs; none for the join.
    assert plan.count("Exchange hashpartitioning") == 3


def test_customer_360_moves_each_input_once(small_warehouse):
    w = small_warehouse
    plan = plan_of(marts.customer_360(w.customers, w.transactions, w.events))
    main = plan[: plan.index("Subquery")] + plan[plan.rindex("FileScan"):]
    assert main.count("SortMergeJoin") == 2


def test_a_hot_campaign_is_one_row_in_the_join(spark):
    """One campaign with half of all rows: sums are folded before the join, values travel as distinct pairs."""
    count = 200_000
    tx = spark.range(0, count, 1, 8).select(
        F.concat(F.lit("t"), F.col("id")).alias("transaction_id"), (F.col("id") % 5000).alias("customer_id"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 900 + 2).alias("campaign_id"),
        F.lit(1).cast("decimal(18,4)").alias("net_revenue"), F.lit(False).alias("refund_flag"))
    campaigns = spark.range(1, 1000).select(F.col("id").alias("campaign_id"), F.lit("Email").alias("channel"))
    w = fixed_warehouse(spark, transactions=stage(tx, "test"), campaigns=stage(campaigns, "test"))
    q02 = CATALOG["q02_revenue_by_channel"](w)
    assert [tuple(row) for row in q02.collect()] == [("Email", count, 5000, float(count), 1.0, 0)]
    sheet = CATALOG["xl_channel_rev"](w)
    assert [tuple(row) for row in sheet.collect()] == [("Email", count, float(count), 5000, 1.0)]


@pytest.mark.parametrize("name", ["q02_revenue_by_channel", "xl_channel_rev"])
def test_channel_reports_repeat_no_rows(small_warehouse, name):
    assert "Expand" not in plan_of(CATALOG[name](small_warehouse))


def test_cohort_counts_need_no_distinct_shuffle(small_warehouse):
    plan = plan_of(CATALOG["q16_cohort_retention"](small_warehouse))
    assert not re.search(r"Exchange hashpartitioning\(cohort_month#\d+, months_since_signup#\d+, customer_id", plan)
    assert plan.count("Exchange hashpartitioning") == 4


def test_order_lines_are_not_sorted_for_their_join(spark):
    plan = plan_of(raw_tables(spark, "/root/testdata/sf0.001")["transactions"])
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
