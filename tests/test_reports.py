"""Report rules the test data does not exercise: nulls, zeros, ties, absent values."""

import datetime

import pytest
from pyspark.sql import functions as F

from cartlens.plans import behaviour, campaigns, charts, customers, eda, revenue, sql_reports, star, workbook
from tests.fixtures import by_key, fixed_warehouse, rows_of, table


def events(spark, *rows):
    return fixed_warehouse(spark, events=table(spark, "events", [dict(event_id=i, **r) for i, r in enumerate(rows)]))


def transactions(spark, *rows):
    data = [dict(transaction_id=f"t{i:02d}", **row) for i, row in enumerate(rows)]
    return fixed_warehouse(spark, transactions=table(spark, "transactions", data))


def test_source_without_views_under_three_rules(spark):
    w = events(spark, *[dict(traffic_source="s", event_type="purchase")] * 3,
               dict(traffic_source="t", event_type="view"))
    assert by_key(sql_reports.funnel_by_source(w), "traffic_source", "conversion_rate") == {"s": (None,), "t": (0.0,)}
    assert by_key(behaviour.source_conversion(w), "traffic_source", "conversion_rate", "bounce_rate") == {
        "s": (None, None), "t": (0.0, 0.0)}
    assert by_key(charts.source_conversion(w), "traffic_source", "conv") == {"s": (300.0,), "t": (0.0,)}


def test_null_groups_stay_in_sql_reports_and_leave_the_others(spark):
    w = events(spark, dict(traffic_source=None, experiment_group=None, device_type=None, page_category=None),
               dict(traffic_source="s", experiment_group="Control", device_type="m", page_category="p"))
    assert {r[0] for r in rows_of(sql_reports.funnel_by_source(w))} == {None, "s"}
    assert {r[0] for r in rows_of(sql_reports.ab_groups(w))} == {None, "Control"}
    assert {r[0] for r in rows_of(sql_reports.funnel_by_device(w))} == {"m"}
    assert {r[0] for r in rows_of(behaviour.source_conversion(w))} == {"s"}
    assert {r[0] for r in rows_of(campaigns.ab_summary(w))} == {"Control"}
    assert {r[0] for r in rows_of(behaviour.device_funnel(w))} == {"m"}
    assert {r[0] for r in rows_of(behaviour.session_duration_by_page(w))} == {"p"}


def test_nulls_sort_last(spark):
    w = events(spark, dict(traffic_source="only purchases", event_type="purchase"),
               dict(traffic_source="low", event_type="view"),
               *[dict(traffic_source="high", event_type=kind) for kind in ("view", "purchase")])
    assert [r[0] for r in rows_of(sql_reports.funnel_by_source(w))] == ["high", "low", "only purchases"]


def test_ab_test_with_more_purchases_than_sessions(spark):
    rows = [dict(experiment_group="Control", session_id="a", event_type="purchase")] * 3
    rows += [dict(experiment_group="Variant_A", session_id=s, event_type="view") for s in "xyz"]
    assert rows_of(campaigns.ab_chi_square(events(spark, *rows)), "control_purchases", "chi2", "p_value",
                   "significant") == [(3, None, None, None)]


def test_ab_conversion_marks_the_first_of_equals(spark):
    rows = [dict(experiment_group=g, session_id=f"{g}{i}", event_type="purchase" if i else "view")
            for g in ("B", "A") for i in range(2)]
    assert by_key(charts.ab_conversion(events(spark, *rows)), "experiment_group", "conv", "is_best") == {
        "A": (0.5, True), "B": (0.5, False)}


def test_heatmap_has_all_weekdays_and_hours(spark):
    w = events(spark, dict(timestamp="2024-01-06 23:10:00"), dict(timestamp="2024-01-06 23:50:00"))
    matrix = rows_of(behaviour.activity_heatmap(w))
    assert [row[0] for row in matrix][:2] == ["Monday", "Tuesday"] and len(matrix) == 7
    assert [sum(row[1:]) for row in matrix] == [0, 0, 0, 0, 0, 2, 0]
    assert matrix[5][24] == 2


def test_months_with_refunds_and_missing_amounts(spark):
    w = transactions(
        spark,
        dict(timestamp="2024-01-05", gross_revenue=10),
        dict(timestamp="2024-01-06", gross_revenue=None),
        dict(timestamp="2024-01-07", gross_revenue=4, refund_flag=1),
        dict(timestamp="2024-02-01", gross_revenue=None),
    )
    assert rows_of(revenue.monthly(w)) == [("2024-01", 3, 10.0, 14.0, 1, 5.0), ("2024-02", 1, 0.0, 0.0, 0, None)]
    # The SQL report leaves a sum over nothing but nulls null.
    assert rows_of(sql_reports.monthly_revenue(w))[1] == ("2024-02", 1, None, None, None, 0)
    assert rows_of(revenue.refund_rate_overall(w)) == [(25.0,)]


def test_rounding_rule_follows_the_report(spark):
    # Mean of 0.12 and 0.13 is 0.125.
    w = transactions(spark, dict(gross_revenue="0.12"), dict(gross_revenue="0.13"))
    assert rows_of(sql_reports.monthly_revenue(w), "aov") == [(0.13,)]
    assert rows_of(workbook.monthly_revenue(w), "avg_order_value") == [(0.12,)]


def test_discount_groups(spark):
    w = transactions(spark, dict(discount_applied=None, gross_revenue=10), dict(discount_applied="0.2", quantity=3))
    assert rows_of(revenue.discount_impact(w)) == [(False, 1, 10.0, 2.0), (True, 1, 50.0, 3.0)]


def test_date_dimension(spark):
    w = transactions(spark, dict(timestamp="2023-12-31 22:00:00"), dict(timestamp="2025-01-01 03:00:00"))
    days = {row.date: row for row in star.dim_date(w).collect()}
    first, last = datetime.date(2023, 12, 31), datetime.date(2025, 1, 1)
    assert sorted(days) == [str(first + datetime.timedelta(i)) for i in range((last - first).days + 1)]
    for text, row in days.items():
        day = datetime.date.fromisoformat(text)
        assert tuple(row) == (
            text, day.year, f"{day.year}Q{(day.month + 2) // 3}", text[:7], day.month, day.strftime("%B"),
            day.isocalendar().week, day.strftime("%A"), int(day.weekday() >= 5))


def test_channel_revenue_rules(spark):
    tables = dict(
        campaigns=table(spark, "campaigns", [dict(campaign_id=1, channel="Email"), dict(campaign_id=1, channel="Email"),
                                             dict(campaign_id=2, channel=None)]),
        transactions=table(spark, "transactions", [
            dict(transaction_id="a", campaign_id=1, customer_id=1), dict(transaction_id="a", campaign_id=1, customer_id=2),
            dict(transaction_id="b", campaign_id=2), dict(transaction_id="c", campaign_id=None),
            dict(transaction_id="d", campaign_id=77)]),
    )
    w = fixed_warehouse(spark, **tables)
    # A campaign listed twice doubles the joined rows but not the distinct counts; unknown ones go.
    assert by_key(sql_reports.revenue_by_channel(w), "channel", "orders", "unique_customers", "net_revenue") == {
        "Email": (1, 2, 200.0), None: (1, 1, 50.0)}
    assert by_key(workbook.channel_revenue(w), "channel", "orders", "unique_customers", "net_revenue") == {
        "Email": (2, 2, 100.0)}


def test_cohorts(spark):
    w = fixed_warehouse(
        spark,
        customers=table(spark, "customers", [dict(customer_id=1, signup_date="2023-11-20"),
                                             dict(customer_id=2, signup_date="2023-11-01"),
                                             dict(customer_id=3, signup_date=None)]),
        transactions=table(spark, "transactions", [
            dict(customer_id=1, timestamp="2023-11-30"), dict(customer_id=1, timestamp="2023-11-21"),
            dict(customer_id=2, timestamp="2023-11-02"), dict(customer_id=2, timestamp="2024-10-31 23:59:59"),
            dict(customer_id=2, timestamp="2024-11-01"), dict(customer_id=2, timestamp="2023-10-31"),
            dict(customer_id=1, timestamp="2024-01-01", refund_flag=1), dict(customer_id=3)]),
    )
    assert rows_of(sql_reports.cohort_retention(w)) == [("2023-11", 0, 2), ("2023-11", 11, 1)]


def customer_mart(spark, rows):
    schema = ("customer_id bigint, country string, loyalty_tier string, acquisition_channel string, "
              "total_orders bigint, total_revenue double, avg_order_value double, recency_days bigint, "
              "rfm_segment string, has_purchased boolean")
    mart = spark.createDataFrame(rows, schema).withColumn("total_revenue", F.col("total_revenue").cast("decimal(28,4)"))
    return fixed_warehouse(spark, mart_customer_360=mart)


@pytest.fixture
def three_customers(spark):
    return customer_mart(spark, [
        (1, "US", "Gold", "Paid", 2, 30.0, 15.0, 3, "Champions", True),
        (2, None, "Bronze", None, 1, 10.0, 10.0, 9, "Lost", True),
        (3, "BR", None, "Paid", 0, 0.0, None, None, None, False),
    ])


def test_customer_reports(three_customers):
    w = three_customers
    assert rows_of(customers.segment_share(w)) == [("Champions", 1, 50.0), ("Lost", 1, 50.0)]
    assert rows_of(customers.ltv_gap(w)) == [(3.0,)]
    assert rows_of(customers.tier_performance(w)) == [
        ("Bronze", 10.0, 1.0, 10.0), ("Silver", None, None, None), ("Gold", 30.0, 2.0, 15.0),
        ("Platinum", None, None, None)]
    assert rows_of(customers.acquisition_performance(w)) == [("Paid", 1, 30.0, 2.0)]
    assert rows_of(customers.top_countries(w)) == [("US", 30.0)]
    assert rows_of(charts.segment_counts(w)) == [("Champions", 1), ("Lost", 1)]
    assert [r[0] for r in rows_of(sql_reports.loyalty_tiers(w))] == ["Bronze", "Gold", None]
    assert {r[0] for r in rows_of(sql_reports.country_breakdown(w))} == {"US", None}


def test_ltv_gap_without_lost_customers(spark):
    w = customer_mart(spark, [(1, "US", "Gold", "Paid", 2, 30.0, 15.0, 3, "Champions", True)])
    assert rows_of(customers.ltv_gap(w)) == [(None,)]


def test_signup_matrix(spark):
    w = fixed_warehouse(spark, customers=table(spark, "customers", [
        dict(customer_id=1, signup_date="2024-01-03", acquisition_channel="Paid"),
        dict(customer_id=2, signup_date="2024-01-09", acquisition_channel="Paid"),
        dict(customer_id=3, signup_date="2024-02-01", acquisition_channel="Or`gan.ic"),
        dict(customer_id=4, signup_date=None), dict(customer_id=5, acquisition_channel=None)]))
    matrix = customers.signup_matrix(w)
    assert matrix.columns == ["signup_month", "Or`gan.ic", "Paid"]
    assert rows_of(customers.signup_counts(w).orderBy("signup_month")) == [
        ("2024-01", "Paid", 2), ("2024-02", "Or`gan.ic", 1)]
    assert [tuple(r) for r in matrix.collect()] == [("2024-01", 0, 2), ("2024-02", 1, 0)]


def test_null_percentages(spark):
    w = fixed_warehouse(
        spark,
        campaigns=table(spark, "campaigns", [{}]), products=table(spark, "products", [{}]),
        transactions=table(spark, "transactions", [{}]), events=table(spark, "events", [{}]),
        customers=table(spark, "customers", [dict(age="?"), {}, {}]))
    assert rows_of(eda.null_percentages(w)) == [("customers", "age", 33.33)]


def test_tier_counts_show_every_tier(spark):
    w = fixed_warehouse(spark, customers=table(spark, "customers", [{}, {}, dict(loyalty_tier="Diamond")]))
    assert rows_of(eda.tier_counts(w)) == [("Bronze", 0), ("Silver", 0), ("Gold", 2), ("Platinum", 0)]


def test_titles(spark):
    assert workbook.titled(spark.sql("SELECT 1 AS avg_order_value, 2 AS orders")).columns == [
        "Avg Order Value", "Orders"]
