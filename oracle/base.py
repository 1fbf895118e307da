"""Shared parts of the check queries: the cleaned tables and marts as SQL, written from the rules.

The check queries run in DuckDB on the same Parquet tables. Nothing here is generated from a Spark
plan; values the cleaners must produce are written directly from the source columns.
"""

from __future__ import annotations


def half_even(x: str, digits: int) -> str:
    """Round to the even neighbour on a tie, computed on the scaled double."""
    m = f"1e{digits}"
    y = f"(({x}) * {m})"
    return (
        f"(CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) / {m} ELSE round({y}) / {m} END)"
    )


def half_up(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits})"


def mean(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / nullif(count({x}), 0)"


def mean_rate(x: str) -> str:
    """Mean of values with four digits, added up exactly."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) / nullif(count({x}), 0)"


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def n_of(kind: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{kind}')"


CTES = {
    "campaigns": """
        SELECT s_suppkey AS campaign_id,
               ['Email', 'Paid Search', 'Social', 'Display', 'Affiliate'][s_suppkey % 5 + 1] AS channel,
               ['acquisition', 'retention', 'upsell', 'awareness'][s_suppkey % 4 + 1] AS objective,
               DATE '1995-01-01' + CAST(s_suppkey * 7 % 2000 AS INT) AS start_date,
               DATE '1995-01-01' + CAST(s_suppkey * 7 % 2000 + 14 + s_suppkey % 60 AS INT) AS end_date,
               ['New', 'Returning', 'VIP'][s_nationkey % 3 + 1] AS target_segment,
               s_acctbal / 100000 AS expected_uplift,
               CAST(14 + s_suppkey % 60 AS INT) AS duration_days
        FROM supplier WHERE s_suppkey > 0""",
    "customers": """
        SELECT c_custkey AS customer_id,
               CAST(f.first_order AS DATE) AS signup_date,
               upper(n_name) AS country,
               CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(18 + c_custkey % 60 AS DOUBLE) END AS age,
               ['Female', 'Male', 'Other'][c_custkey % 3 + 1] AS gender,
               CASE WHEN c_acctbal < 2500 THEN 'Bronze' WHEN c_acctbal < 5000 THEN 'Silver'
                    WHEN c_acctbal < 7500 THEN 'Gold' ELSE 'Platinum' END AS loyalty_tier,
               c_mktsegment AS acquisition_channel
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
               ON f.o_custkey = c_custkey""",
    "products": """
        SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand,
               CAST(p_retailprice AS DECIMAL(18,2)) AS base_price,
               DATE '1994-01-01' + CAST(p_partkey % 365 AS INT) AS launch_date,
               p_size > 25 AS is_premium
        FROM part""",
    "transactions": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS transaction_id,
               o_orderdate AS ts,
               o_custkey AS customer_id,
               l_partkey AS product_id,
               CAST(l_quantity AS INT) AS quantity,
               CAST(l_discount AS DECIMAL(18,2)) AS discount_applied,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_revenue,
               l_suppkey AS campaign_id,
               l_returnflag = 'R' AS refund_flag,
               CAST(o_orderdate AS DATE) AS day,
               strftime(o_orderdate, '%Y-%m') AS month,
               CAST(year(o_orderdate) AS INT) AS year,
               CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS net_revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "clicks": """
        SELECT event_id, ts, user_id AS customer_id, user_id * 100 + day(ts) AS session_id,
               CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'bounce'
                    ELSE event_type END AS event_type,
               CASE WHEN event_type <> 'error' THEN event_id % 200 END AS product_id,
               ['mobile', 'desktop', 'tablet'][event_id % 3 + 1] AS device_type,
               ['Organic', 'Direct', 'Paid', 'Email', 'Referral'][event_id % 5 + 1] AS traffic_source,
               CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 + event_id % 99 END AS campaign_id,
               ['Home', 'Product', 'Cart', 'Checkout'][event_id % 4 + 1] AS page_category,
               CAST(value AS DECIMAL(18,2)) AS session_duration_sec,
               ['Control', 'Variant_A', 'Variant_B'][user_id % 3 + 1] AS experiment_group
        FROM events""",
    "tx_agg": f"""
        SELECT customer_id,
               count(*) FILTER (WHERE NOT refund_flag) AS total_orders,
               CAST(sum(net_revenue) AS DECIMAL(38,2)) AS total_revenue,
               CAST(sum(gross_revenue) FILTER (WHERE NOT refund_flag) AS DOUBLE)
                   / count(*) FILTER (WHERE NOT refund_flag) AS avg_order_value,
               CAST(sum(quantity) FILTER (WHERE NOT refund_flag) AS BIGINT) AS total_quantity,
               min(ts) FILTER (WHERE NOT refund_flag) AS first_purchase,
               max(ts) FILTER (WHERE NOT refund_flag) AS last_purchase,
               count(*) FILTER (WHERE refund_flag) AS refund_count,
               count(*) FILTER (WHERE NOT refund_flag AND discount_applied > 0) AS discount_used_count
        FROM transactions GROUP BY customer_id HAVING count(*) FILTER (WHERE NOT refund_flag) > 0""",
    "dated": """
        SELECT *, CAST(floor(epoch(newest - last_purchase) / 86400) AS BIGINT) AS recency_days,
               CAST(floor(epoch(last_purchase - first_purchase) / 86400) AS BIGINT) AS customer_lifetime_days
        FROM tx_agg, (SELECT max(ts) AS newest FROM transactions)""",
    "ranked": """
        SELECT *, count(*) OVER () AS n,
               row_number() OVER (ORDER BY recency_days, customer_id) AS r_rank,
               row_number() OVER (ORDER BY total_orders, customer_id) AS f_rank,
               row_number() OVER (ORDER BY total_revenue, customer_id) AS m_rank
        FROM dated""",
    "scored": """
        SELECT *, r_score + f_score + m_score AS rfm_score,
               CASE WHEN r_score + f_score + m_score >= 13 THEN 'Champions'
                    WHEN r_score + f_score + m_score >= 10 THEN 'Loyal'
                    WHEN r_score + f_score + m_score >= 7 THEN 'Potential Loyalist'
                    WHEN r_score + f_score + m_score >= 5 THEN 'At Risk' ELSE 'Lost' END AS rfm_segment
        FROM (SELECT *,
                     CAST(6 - greatest(1, (5 * (r_rank - 1) + n - 2) // (n - 1)) AS INT) AS r_score,
                     CAST(greatest(1, (5 * (f_rank - 1) + n - 2) // (n - 1)) AS INT) AS f_score,
                     CAST(greatest(1, (5 * (m_rank - 1) + n - 2) // (n - 1)) AS INT) AS m_score
              FROM ranked)""",
    "event_agg": f"""
        SELECT customer_id, count(event_id) AS total_events, count(DISTINCT session_id) AS total_sessions,
               {n_of("purchase")} AS purchase_events, {n_of("bounce")} AS bounce_events,
               {mean("session_duration_sec")} AS avg_session_duration,
               count(DISTINCT device_type) AS devices_used,
               {half_even(ratio(n_of("purchase"), "count(DISTINCT session_id)"), 4)} AS conversion_rate
        FROM clicks GROUP BY customer_id""",
    "c360": """
        SELECT c.*, coalesce(t.total_orders, 0) AS total_orders,
               CAST(coalesce(t.total_revenue, 0) AS DECIMAL(38,2)) AS total_revenue,
               t.avg_order_value, t.total_quantity, t.first_purchase, t.last_purchase, t.refund_count,
               t.discount_used_count, t.recency_days, t.customer_lifetime_days, t.r_score, t.f_score,
               t.m_score, t.rfm_score, t.rfm_segment, e.total_events, e.total_sessions, e.purchase_events,
               e.bounce_events, e.avg_session_duration, e.devices_used, e.conversion_rate,
               t.total_orders IS NOT NULL AND t.total_orders > 0 AS has_purchased
        FROM customers c LEFT JOIN scored t USING (customer_id) LEFT JOIN event_agg e USING (customer_id)""",
    "camp_tx": f"""
        SELECT campaign_id, count(transaction_id) AS tx_count, sum(gross_revenue) AS gross_revenue,
               sum(net_revenue) AS net_revenue, count(*) FILTER (WHERE refund_flag) AS refunds,
               {mean("discount_applied")} AS avg_discount, count(DISTINCT customer_id) AS unique_customers
        FROM transactions GROUP BY campaign_id""",
    "camp_events": f"""
        SELECT campaign_id, count(event_id) AS impressions, count(DISTINCT customer_id) AS unique_visitors,
               {n_of("purchase")} AS purchases, {n_of("bounce")} AS bounces,
               {n_of("add_to_cart")} AS add_to_carts, {mean("session_duration_sec")} AS avg_session_sec
        FROM clicks GROUP BY campaign_id""",
    "camp_rates": f"""
        SELECT *, {half_even(ratio("bounces", "impressions"), 4)} AS bounce_rate,
               {half_even(ratio("add_to_carts", "impressions"), 4)} AS click_to_cart_rate,
               {half_even(ratio("purchases", "unique_visitors"), 4)} AS conversion_rate
        FROM camp_events""",
    "camp_joined": """
        SELECT c.*, t.* EXCLUDE (campaign_id), r.* EXCLUDE (campaign_id)
        FROM campaigns c LEFT JOIN camp_tx t USING (campaign_id) LEFT JOIN camp_rates r USING (campaign_id)""",
    "perf": f"""
        SELECT j.*,
               {half_even("(CAST(net_revenue AS DOUBLE) - mid) / nullif(mid, 0)", 4)} AS roi,
               {half_even(ratio("net_revenue", "unique_visitors"), 2)} AS revenue_per_visitor
        FROM camp_joined j, (SELECT median(CAST(net_revenue AS DOUBLE)) AS mid FROM camp_joined)""",
    "stages": f"""
        SELECT 1 AS no, 'view' AS stage, {n_of("view")} AS n FROM clicks UNION ALL
        SELECT 2, 'click', {n_of("click")} FROM clicks UNION ALL
        SELECT 3, 'add_to_cart', {n_of("add_to_cart")} FROM clicks UNION ALL
        SELECT 4, 'purchase', {n_of("purchase")} FROM clicks""",
    "funnel": f"""
        SELECT no, stage, n AS count,
               {half_even("1 - " + ratio("n", "lag(n) OVER (ORDER BY no)"), 4)} AS drop_off_rate,
               {half_even(ratio("n", "first_value(n) OVER (ORDER BY no)"), 4)} AS conversion_from_top
        FROM stages""",
    "sold": f"""
        SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units_sold, sum(net_revenue) AS total_revenue,
               {mean("net_revenue")} AS avg_revenue_per_tx, count(transaction_id) AS order_count,
               count(DISTINCT customer_id) AS unique_buyers, {mean("discount_applied")} AS discount_rate
        FROM transactions WHERE NOT refund_flag GROUP BY product_id""",
    "prod": """
        SELECT p.*, CAST(coalesce(s.units_sold, 0) AS BIGINT) AS units_sold,
               CAST(coalesce(s.total_revenue, 0) AS DECIMAL(38,2)) AS total_revenue,
               s.avg_revenue_per_tx, s.order_count, s.unique_buyers, s.discount_rate
        FROM products p LEFT JOIN sold s USING (product_id)""",
}

NEEDS = {
    "tx_agg": ["transactions"],
    "dated": ["transactions", "tx_agg"],
    "ranked": ["transactions", "tx_agg", "dated"],
    "scored": ["transactions", "tx_agg", "dated", "ranked"],
    "event_agg": ["clicks"],
    "c360": ["customers", "transactions", "tx_agg", "dated", "ranked", "scored", "clicks", "event_agg"],
    "camp_tx": ["transactions"],
    "camp_events": ["clicks"],
    "camp_rates": ["clicks", "camp_events"],
    "camp_joined": ["campaigns", "transactions", "clicks", "camp_tx", "camp_events", "camp_rates"],
    "perf": ["campaigns", "transactions", "clicks", "camp_tx", "camp_events", "camp_rates", "camp_joined"],
    "stages": ["clicks"],
    "funnel": ["clicks", "stages"],
    "sold": ["transactions"],
    "prod": ["products", "transactions", "sold"],
}


def over(tables: str, body: str) -> str:
    """`body` with the named shared tables (and what they need) in front of it."""
    wanted: set[str] = set()
    for table in tables.split():
        wanted |= {table, *NEEDS.get(table, [])}
    parts = [f"{name} AS ({sql})" for name, sql in CTES.items() if name in wanted]
    return f"WITH {', '.join(parts)} {body}"
