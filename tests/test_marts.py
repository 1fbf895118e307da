"""Mart rules on hand-made rows, and identities on the small test data."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.plans import marts
from cartlens.vocabulary import SEGMENTS
from tests.fixtures import by_key, rows_of, table


def tx(spark, *rows):
    return table(spark, "transactions", [dict(transaction_id=f"t{i}", **row) for i, row in enumerate(rows)])


def test_purchases_keep_refunds_apart(spark):
    transactions = tx(
        spark,
        dict(customer_id=1, gross_revenue=50, quantity=2, discount_applied="0"),
        dict(customer_id=1, gross_revenue=30, quantity=1),
        dict(customer_id=1, gross_revenue=99, quantity=9, refund_flag=1),
        dict(customer_id=2, gross_revenue=10, refund_flag=1),
        dict(customer_id=3, gross_revenue=None),
        dict(customer_id=None, gross_revenue=5),
    )
    agg = marts.customer_tx_agg(marts.customer_purchases(transactions))
    result = by_key(agg, "customer_id", "total_orders", F.col("total_revenue").cast("double"), "avg_order_value",
                    "total_quantity", "refund_count", "discount_used_count")
    # A customer with refunds only has no row; a missing amount adds 0 and is left out of the mean.
    assert result == {1: (2, 80.0, 40.0, 3, 1, 1), 3: (1, 0.0, None, 2, 0, 1)}


def test_recency_counts_whole_days_to_the_latest_transaction_of_any_kind(spark):
    transactions = tx(
        spark,
        dict(customer_id=1, timestamp="2024-01-01 23:00:00"),
        dict(customer_id=1, timestamp="2024-01-02 01:00:00"),
        dict(customer_id=2, timestamp="2024-01-03 00:30:00", refund_flag=1),
    )
    dated = marts.recency_lifetime(marts.customer_purchases(transactions))
    assert by_key(dated, "customer_id", "recency_days", "customer_lifetime_days") == {1: (0, 0)}


def test_scores_of_tied_customers(spark):
    transactions = tx(spark, *[dict(customer_id=i, gross_revenue=10) for i in range(7)])
    scored = marts.scored_customers(transactions)
    expected = {i: [1, 1, 2, 3, 4, 5, 5][i] for i in range(7)}
    result = by_key(scored, "customer_id", "r_score", "f_score", "m_score")
    assert result == {i: (6 - b, b, b) for i, b in expected.items()}


def test_one_buyer_has_no_score(spark):
    scored = marts.scored_customers(tx(spark, dict(customer_id=4)))
    assert rows_of(scored, "r_score", "rfm_score", "rfm_segment") == [(None, None, None)]


def test_event_agg(spark):
    events = table(spark, "events", [
        dict(event_id=1, customer_id=1, session_id="a", event_type="view", device_type="x", session_duration_sec=1),
        dict(event_id=2, customer_id=1, session_id="a", event_type="purchase", device_type="y",
             session_duration_sec=2),
        dict(event_id=3, customer_id=1, session_id="b", event_type="bounce", device_type="x",
             session_duration_sec=None),
        dict(event_id=4, customer_id=1, session_id="c", event_type="purchase", device_type=None,
             session_duration_sec=6),
        dict(event_id=5, customer_id=None),
        dict(event_id=6, customer_id=2, session_id=None),
    ])
    assert by_key(marts.customer_event_agg(events), "customer_id", "total_events", "total_sessions",
                  "purchase_events", "bounce_events", "avg_session_duration", "devices_used",
                  "conversion_rate") == {1: (4, 3, 2, 1, 3.0, 2, 0.6667), 2: (1, 0, 0, 0, 12.5, 1, None)}


def test_customer_360_without_activity(spark):
    customers = table(spark, "customers", [dict(customer_id=1), dict(customer_id=2)])
    mart = marts.customer_360(customers, tx(spark, dict(customer_id=1), dict(customer_id=9)),
                              table(spark, "events", [dict(customer_id=2)]))
    result = by_key(mart, "customer_id", "has_purchased", "total_orders", F.col("total_revenue").cast("double"),
                    "total_quantity", "total_events")
    assert result == {1: (True, 1, 50.0, 2, None), 2: (False, 0, 0.0, None, 1)}


def test_campaign_performance(spark):
    campaigns = table(spark, "campaigns", [dict(campaign_id=i) for i in (1, 2, 3)])
    transactions = tx(
        spark,
        dict(campaign_id=1, customer_id=1, gross_revenue=100),
        dict(campaign_id=1, customer_id=1, gross_revenue=60, refund_flag=1, discount_applied=None),
        dict(campaign_id=2, customer_id=2, gross_revenue=300),
        dict(campaign_id=None, customer_id=3, gross_revenue=7),
    )
    events = table(spark, "events", [
        dict(campaign_id=1, customer_id=1, event_type="view"),
        dict(campaign_id=1, customer_id=2, event_type="purchase"),
        dict(campaign_id=1, customer_id=2, event_type="bounce"),
        dict(campaign_id=1, customer_id=None, event_type="add_to_cart"),
    ])
    mart = marts.campaign_performance(campaigns, transactions, events)
    result = by_key(mart, "campaign_id", "tx_count", F.col("gross_revenue").cast("double"),
                    F.col("net_revenue").cast("double"), "refunds", "avg_discount", "unique_customers",
                    "unique_visitors", "bounce_rate", "conversion_rate", "roi", "revenue_per_visitor")
    # Median of the campaigns that have revenue: (100 + 300) / 2.
    assert result == {
        1: (2, 160.0, 100.0, 1, 0.05, 1, 2, 0.25, 0.5, -0.5, 50.0),
        2: (1, 300.0, 300.0, 0, 0.1, 1, None, None, None, 0.5, None),
        3: (None,) * 11,
    }


def test_funnel_with_a_missing_stage(spark):
    kinds = ["view"] * 4 + ["add_to_cart"] * 2 + ["purchase"] + ["bounce"] * 9
    funnel = marts.funnel(table(spark, "events", [dict(event_type=kind) for kind in kinds]))
    assert rows_of(funnel) == [
        ("view", 4, None, 1.0), ("click", 0, 1.0, 0.0), ("add_to_cart", 2, None, 0.5), ("purchase", 1, 0.5, 0.25),
    ]


def test_funnel_of_nothing(spark):
    funnel = marts.funnel(table(spark, "events", [dict(event_type="bounce")]))
    assert rows_of(funnel, "count", "conversion_from_top") == [(0, None)] * 4


def test_product_performance(spark):
    products = table(spark, "products", [dict(product_id=1), dict(product_id=2)])
    transactions = tx(
        spark,
        dict(product_id=1, customer_id=1, quantity=2, gross_revenue=10),
        dict(product_id=1, customer_id=1, quantity=1, gross_revenue=20, discount_applied="0.3"),
        dict(product_id=1, customer_id=2, quantity=5, gross_revenue=99, refund_flag=1),
        dict(product_id=None, customer_id=2),
    )
    mart = marts.product_performance(products, transactions)
    result = by_key(mart, "product_id", "units_sold", F.col("total_revenue").cast("double"), "avg_revenue_per_tx",
                    "order_count", "unique_buyers", "discount_rate")
    assert result == {1: (3, 30.0, 15.0, 2, 1, 0.2), 2: (0, 0.0, None, None, None, None)}


# --- identities on the test data ---------------------------------------------------------------


def test_orders_add_up(small_warehouse):
    w = small_warehouse
    kept = w.transactions.where("NOT refund_flag").count()
    assert w.customer_360.agg(F.sum("total_orders")).first()[0] == kept
    assert w.customer_360.count() == w.customers.count()


@pytest.mark.parametrize("measure, column, descending", [
    ("recency_days", "r_score", True), ("total_orders", "f_score", False), ("total_revenue", "m_score", False),
])
def test_scores_equal_a_plain_global_rank(small_warehouse, measure, column, descending):
    buyers = small_warehouse.customer_360.where("has_purchased")
    n = buyers.count()
    place = F.row_number().over(Window.orderBy(measure, "customer_id"))
    bucket = F.greatest(F.lit(1), F.floor((5 * (place - 1) + n - 2) / (n - 1)))
    expected = buyers.select("customer_id", (6 - bucket if descending else bucket).cast("int").alias(column))
    assert sorted(rows_of(expected)) == sorted(rows_of(buyers, "customer_id", column))


def test_segments_are_known(small_warehouse):
    found = {row[0] for row in rows_of(small_warehouse.customer_360.select("rfm_segment").distinct())}
    assert found <= {*SEGMENTS, None}
