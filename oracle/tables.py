"""Check queries of the sources, sinks, cleaners, marts and the star schema."""

from __future__ import annotations

from oracle.base import half_even, half_up, mean, n_of, over, ratio

RAW_TYPES = {
    "campaigns": {
        "campaign_id": "bigint", "channel": "string", "objective": "string", "start_date": "date",
        "end_date": "date", "target_segment": "string", "expected_uplift": "double",
    },
    "customers": {
        "customer_id": "bigint", "signup_date": "date", "country": "string", "age": "string",
        "gender": "string", "loyalty_tier": "string", "acquisition_channel": "string",
    },
    "events": {
        "event_id": "bigint", "timestamp": "timestamp_ntz", "customer_id": "bigint", "session_id": "bigint",
        "event_type": "string", "product_id": "bigint", "device_type": "string", "traffic_source": "string",
        "campaign_id": "bigint", "page_category": "string", "session_duration_sec": "double",
        "experiment_group": "string",
    },
    "products": {
        "product_id": "bigint", "category": "string", "brand": "string", "base_price": "string",
        "launch_date": "date", "is_premium": "int",
    },
    "transactions": {
        "transaction_id": "string", "timestamp": "timestamp_ntz", "customer_id": "bigint",
        "product_id": "bigint", "quantity": "double", "discount_applied": "double",
        "gross_revenue": "decimal(18,2)", "campaign_id": "bigint", "refund_flag": "int",
    },
}
# Raw columns that can be null, as a condition on the cleaned table; the others never are.
RAW_NULLS = {
    ("customers", "signup_date"): "signup_date IS NULL",
    ("customers", "country"): "country IS NULL",
    ("events", "product_id"): "event_type = 'bounce'",
    ("events", "campaign_id"): "campaign_id = 0",
    ("transactions", "campaign_id"): "campaign_id = 0",
}
CLEAN_COLUMNS = {
    "campaigns": [*RAW_TYPES["campaigns"], "duration_days"],
    "customers": [*RAW_TYPES["customers"]],
    "events": [*RAW_TYPES["events"], "date", "hour", "day_of_week"],
    "products": [*RAW_TYPES["products"]],
    "transactions": [*RAW_TYPES["transactions"], "date", "month", "year", "net_revenue"],
}
# The shared tables avoid a few names that are SQL keywords or source tables.
SQL_NAME = {"events": "clicks"}
SQL_COLUMN = {"timestamp": "ts", "date": "CAST(ts AS DATE)", "hour": "hour(ts)", "day_of_week": "dayname(ts)"}
ALL = "campaigns customers products transactions clicks"


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def _sizes(widths: dict[str, int]) -> str:
    return over(ALL, _union([
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({width} AS INT) AS column_count "
        f"FROM {SQL_NAME.get(t, t)}"
        for t, width in widths.items()
    ]))


def _null_rows(select: str) -> str:
    return over(ALL, f"SELECT {select} FROM (" + _union([
        f"SELECT '{t}' AS table_name, count(*) AS row_count, '{c}' AS column_name, "
        f"count(*) - count({SQL_COLUMN.get(c, c)}) AS null_count FROM {SQL_NAME.get(t, t)}"
        for t, columns in CLEAN_COLUMNS.items() for c in columns
    ]) + ") WHERE null_count > 0")


CLEAN_TX = """
    SELECT transaction_id, ts AS "timestamp", customer_id, product_id, quantity,
           CAST(discount_applied AS DOUBLE) AS discount_applied, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
           campaign_id, refund_flag, strftime(day, '%Y-%m-%d') AS date, month, year,
           CAST(net_revenue AS DOUBLE) AS net_revenue
    FROM transactions"""
CLEAN_EVENTS = """
    SELECT * EXCLUDE (ts, session_duration_sec), ts AS "timestamp",
           CAST(session_duration_sec AS DOUBLE) AS session_duration_sec,
           strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS day_of_week
    FROM clicks"""
CLEAN_CAMPAIGNS = """
    SELECT * REPLACE (strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date)
    FROM campaigns"""
CLEAN_CUSTOMERS = "SELECT * REPLACE (strftime(signup_date, '%Y-%m-%d') AS signup_date) FROM customers"
CLEAN_PRODUCTS = """
    SELECT * REPLACE (strftime(launch_date, '%Y-%m-%d') AS launch_date, CAST(base_price AS DOUBLE) AS base_price)
    FROM products"""
PRODUCT_MART = """
    SELECT * REPLACE (strftime(launch_date, '%Y-%m-%d') AS launch_date, CAST(base_price AS DOUBLE) AS base_price,
                      CAST(total_revenue AS DOUBLE) AS total_revenue)
    FROM prod"""
FUNNEL = "SELECT * EXCLUDE (no) FROM funnel ORDER BY no"
LOADED = over(ALL + " c360 perf funnel prod", _union([
    f"SELECT '{label}' AS table_name, count(*) AS row_count FROM {table}"
    for label, table in {
        "campaigns": "campaigns", "customers": "customers", "events": "clicks", "products": "products",
        "transactions": "transactions", "mart_customer_360": "c360", "mart_campaign_performance": "perf",
        "mart_funnel": "funnel", "mart_product_performance": "prod",
    }.items()
]))
TX_AGG = "SELECT * REPLACE (CAST(total_revenue AS DOUBLE) AS total_revenue) FROM tx_agg"
DAY_SPAN = "(SELECT min(day) AS lo, max(day) AS hi FROM transactions)"


def values(tables: dict[str, str]) -> str:
    """Sums over the columns of each query's rows, by label."""
    return _union([
        f"""SELECT '{label}' AS table_name, column_name, count(*) AS row_count, count(v) AS filled,
                   CAST(round(sum(TRY_CAST(v AS DECIMAL(38,6))), 3) AS DOUBLE) AS total,
                   CAST(sum(length(v)) FILTER (WHERE TRY_CAST(v AS DECIMAL(38,6)) IS NULL) AS BIGINT) AS letters
            FROM (FROM (SELECT COLUMNS(*)::VARCHAR FROM ({query}))
                  UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(*)))) GROUP BY column_name"""
        for label, query in tables.items()
    ])


def row_sums(tables: dict[str, str]) -> str:
    """Sums of 60 bits each of the digests of the query's rows, by label."""
    number = "CAST(round(TRY_CAST(v AS DECIMAL(38,6)), 3) AS DECIMAL(38,3))::VARCHAR"
    return _union([
        f"""SELECT '{label}' AS table_name, count(*) AS row_count,
                   coalesce(sum(CAST('0x' || substr(digest, 1, 15) AS BIGINT)), 0)::VARCHAR AS first_sum,
                   coalesce(sum(CAST('0x' || substr(digest, 17, 15) AS BIGINT)), 0)::VARCHAR AS second_sum
            FROM (SELECT md5(string_agg(coalesce(length(t) || ':' || t, '-'), '' ORDER BY column_name)) AS digest
                  FROM (SELECT r, column_name, coalesce({number}, nullif(v, '')) AS t
                        FROM (FROM (SELECT row_number() OVER () AS r, COLUMNS(*)::VARCHAR FROM ({query}))
                              UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(* EXCLUDE r))))) GROUP BY r)"""
        for label, query in tables.items()
    ])


def titled(sums: str) -> str:
    """Sheet headers in place of column names."""
    return f"""SELECT * REPLACE (array_to_string(
        [upper(x[1]) || x[2:] FOR x IN string_split(column_name, '_')], ' ') AS column_name) FROM ({sums})"""


SQL = {
    "scan_csv": over("transactions", CLEAN_TX),
    "scan_csv_line_breaks": over("transactions", CLEAN_TX.replace(
        "SELECT transaction_id,", "SELECT concat(transaction_id, chr(10), '\"', product_id, '\",', chr(10), ',') AS transaction_id,")),
    "ingest_rowcount": _sizes({t: len(c) for t, c in RAW_TYPES.items()}),
    "profile_raw": over(ALL, _union([
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS column_type, "
        f"count(*) FILTER (WHERE {RAW_NULLS.get((t, c), 'false')}) AS null_count FROM {SQL_NAME.get(t, t)}"
        for t, columns in RAW_TYPES.items() for c, kind in columns.items()
    ])),
    "write_table": over("transactions", CLEAN_TX),
    "write_mart": over("prod", PRODUCT_MART),
    "post_load_count": LOADED,
    "scan_table": over("clicks", CLEAN_EVENTS),
    "clean_campaigns": over("campaigns", CLEAN_CAMPAIGNS),
    "clean_customers": over("customers", CLEAN_CUSTOMERS),
    "clean_events": over("clicks", CLEAN_EVENTS),
    "clean_products": over("products", CLEAN_PRODUCTS),
    "clean_transactions": over("transactions", CLEAN_TX),
    "clean_all_null_report": _null_rows("*"),
    "eda_table_sizes": _sizes({t: len(c) for t, c in CLEAN_COLUMNS.items()}),
    "eda_null_pct": _null_rows(
        f"table_name, column_name, {half_even(ratio('null_count', 'row_count') + ' * 100', 2)} AS null_pct"
    ),
    "customer_tx_agg": over("tx_agg", TX_AGG),
    "recency_lifetime": over("dated", """
        SELECT customer_id, first_purchase, last_purchase, recency_days, customer_lifetime_days FROM dated"""),
    "rfm_scores": over("scored", """
        SELECT customer_id, recency_days, total_orders, CAST(total_revenue AS DOUBLE) AS total_revenue,
               r_score, f_score, m_score, rfm_score FROM scored"""),
    "rfm_segment": over("scored", "SELECT customer_id, rfm_score, rfm_segment FROM scored"),
    "customer_event_agg": over("event_agg", "SELECT * EXCLUDE (conversion_rate) FROM event_agg"),
    "customer_conversion": over("event_agg", """
        SELECT customer_id, purchase_events, total_sessions, conversion_rate FROM event_agg"""),
    "customer_360": over("c360", """
        SELECT * REPLACE (strftime(signup_date, '%Y-%m-%d') AS signup_date,
                          CAST(total_revenue AS DOUBLE) AS total_revenue) FROM c360"""),
    "campaign_tx_agg": over("camp_tx", """
        SELECT * REPLACE (CAST(gross_revenue AS DOUBLE) AS gross_revenue,
                          CAST(net_revenue AS DOUBLE) AS net_revenue) FROM camp_tx"""),
    "campaign_event_agg": over("camp_events", "SELECT * FROM camp_events"),
    "campaign_rates": over("camp_rates", """
        SELECT campaign_id, bounce_rate, click_to_cart_rate, conversion_rate FROM camp_rates"""),
    "campaign_performance": over("perf", """
        SELECT * REPLACE (strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date,
                          CAST(gross_revenue AS DOUBLE) AS gross_revenue,
                          CAST(net_revenue AS DOUBLE) AS net_revenue) FROM perf"""),
    "campaign_roi": over("perf", "SELECT campaign_id, CAST(net_revenue AS DOUBLE) AS net_revenue, roi FROM perf"),
    "revenue_per_visitor": over("perf", """
        SELECT campaign_id, CAST(net_revenue AS DOUBLE) AS net_revenue, unique_visitors, revenue_per_visitor
        FROM perf"""),
    "funnel": over("funnel", FUNNEL),
    "product_performance": over("prod", PRODUCT_MART),
    "fact_transactions": over("transactions", """
        SELECT transaction_id, strftime(ts, '%Y-%m-%d') AS date, month,
               concat(year(ts), 'Q', quarter(ts)) AS quarter, year, customer_id, product_id, campaign_id,
               quantity, CAST(discount_applied AS DOUBLE) AS discount_applied,
               CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(net_revenue AS DOUBLE) AS net_revenue,
               refund_flag
        FROM transactions"""),
    "dim_customers": over("customers", CLEAN_CUSTOMERS),
    "dim_campaigns": over("campaigns", CLEAN_CAMPAIGNS),
    "dim_products": over("products", CLEAN_PRODUCTS),
    "dim_date": over("transactions", f"""
        SELECT strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS INT) AS year,
               concat(year(d), 'Q', quarter(d)) AS quarter, strftime(d, '%Y-%m') AS month,
               CAST(month(d) AS INT) AS month_num, monthname(d) AS month_name,
               CAST(weekofyear(d) AS INT) AS week, dayname(d) AS day_of_week,
               CAST(isodow(d) >= 6 AS INT) AS is_weekend
        FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM {DAY_SPAN})"""),
    "pbi_customer_360": over("c360", """
        SELECT customer_id, country, age, gender, loyalty_tier, acquisition_channel,
               strftime(signup_date, '%Y-%m-%d') AS signup_date, total_orders,
               CAST(total_revenue AS DOUBLE) AS total_revenue, avg_order_value, recency_days, rfm_score,
               rfm_segment, CAST(has_purchased AS INT) AS has_purchased, r_score, f_score, m_score
        FROM c360"""),
    "pbi_campaign_perf": over("perf", """
        SELECT campaign_id, channel, objective, target_segment, duration_days, tx_count,
               CAST(net_revenue AS DOUBLE) AS net_revenue, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
               refunds, unique_customers, impressions, unique_visitors, purchases, bounces, add_to_carts,
               avg_session_sec, bounce_rate, conversion_rate, revenue_per_visitor, expected_uplift, roi
        FROM perf"""),
    "pbi_funnel": over("funnel", FUNNEL),
    "pbi_product_perf": over("prod", """
        SELECT product_id, category, brand, CAST(base_price AS DOUBLE) AS base_price, is_premium, units_sold,
               CAST(total_revenue AS DOUBLE) AS total_revenue, avg_revenue_per_tx, unique_buyers, discount_rate
        FROM prod"""),
    **{
        key: over("transactions", f"SELECT year, {sql} AS {name} FROM transactions GROUP BY year ORDER BY year")
        for key, name, sql in [
            ("dax_total_revenue", "total_revenue", "CAST(sum(net_revenue) AS DOUBLE)"),
            ("dax_total_orders", "total_orders", "count(*)"),
            ("dax_aov", "average_order_value", mean("net_revenue")),
            ("dax_refund_rate", "refund_rate", ratio("count(*) FILTER (WHERE refund_flag)", "count(*)")),
            ("dax_conversion_rate", "conversion_rate", ratio("count(*)", "count(DISTINCT customer_id)")),
        ]
    },
}

MART_SQL = {
    "mart_customer_360": SQL["customer_360"], "mart_campaign_performance": SQL["campaign_performance"],
    "mart_funnel": SQL["funnel"], "mart_product_performance": SQL["product_performance"],
}
STAR_SQL = {
    "fact_transactions": SQL["fact_transactions"], "dim_customers": SQL["dim_customers"],
    "dim_campaigns": SQL["dim_campaigns"], "dim_products": SQL["dim_products"], "dim_date": SQL["dim_date"],
    "mart_customer_360": SQL["pbi_customer_360"], "mart_campaign_perf": SQL["pbi_campaign_perf"],
    "mart_funnel": SQL["pbi_funnel"], "mart_product_perf": SQL["pbi_product_perf"],
}
SQL |= {
    "build_all": values(MART_SQL),
    "build_warehouse": values({t: SQL[f"clean_{t}"] for t in RAW_TYPES} | MART_SQL),
    "write_csv_star": values(STAR_SQL),
    "write_csv_star_rows": row_sums(STAR_SQL),
    "write_csv_star_differing": """
        SELECT '' AS table_name, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS rows_in_files WHERE false""",
    "clean_date_spellings": SQL["clean_transactions"],
    "date_orders": """
        SELECT 'timestamp' AS column_name, '/' AS separator, 'day first' AS date_order
        UNION ALL SELECT 'timestamp', '.', 'month first'""",
}
SQL |= {
    "publish_warehouse": SQL["build_warehouse"],
    "publish_changes": over("transactions clicks", """
        SELECT 'transactions' AS table_name, month AS part, CASE WHEN month = last THEN 'added' ELSE 'rewritten' END AS change
        FROM (SELECT month, customer_id, min(month) OVER () AS first, max(month) OVER () AS last FROM transactions)
        WHERE month = last OR (month = first AND customer_id % 2 <> 0)
        GROUP BY month, last
        UNION ALL SELECT 'events', strftime(max(ts), '%Y-%m-%d'), 'added' FROM clicks"""),
}

# The last ten days up to the latest one with events.
_LAST_DAYS = "(SELECT * FROM clicks WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM clicks) - 10)"
SQL |= {
    "span_customer_events": over("clicks", f"""
        SELECT customer_id, count(event_id) AS total_events, count(DISTINCT session_id) AS total_sessions,
               {n_of("purchase")} AS purchase_events, {n_of("bounce")} AS bounce_events,
               {mean("session_duration_sec")} AS avg_session_duration, count(DISTINCT device_type) AS devices_used,
               {half_even(ratio(n_of("purchase"), "count(DISTINCT session_id)"), 4)} AS conversion_rate
        FROM {_LAST_DAYS} GROUP BY customer_id"""),
    "span_campaign_events": over("clicks", f"""
        SELECT campaign_id, count(event_id) AS impressions, count(DISTINCT customer_id) AS unique_visitors,
               {n_of("purchase")} AS purchases, {n_of("bounce")} AS bounces, {n_of("add_to_cart")} AS add_to_carts,
               {mean("session_duration_sec")} AS avg_session_sec
        FROM {_LAST_DAYS} GROUP BY campaign_id"""),
    "span_ab_groups": over("clicks", f"""
        SELECT experiment_group, count(DISTINCT session_id) AS sessions, count(DISTINCT customer_id) AS unique_users,
               {n_of("purchase")} AS purchases, {n_of("bounce")} AS bounces,
               {half_up(ratio(n_of("purchase"), "count(DISTINCT session_id)"), 4)} AS conversion_rate,
               {half_up(mean("session_duration_sec"), 1)} AS avg_session_sec
        FROM {_LAST_DAYS} GROUP BY experiment_group"""),
    "span_whole_customer_events": over("event_agg", "SELECT * FROM event_agg"),
}
