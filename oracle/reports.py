"""Check queries of the SQL reports, analyses, workbook tables and chart datasets."""

from __future__ import annotations

from oracle.base import half_even, half_up, mean, mean_rate, n_of, over, ratio

MONEY = "CAST(sum({}) AS DOUBLE)"
NET, GROSS = MONEY.format("net_revenue"), MONEY.format("gross_revenue")
REV = MONEY.format("total_revenue")
REFUNDS = "count(*) FILTER (WHERE refund_flag)"
UNITS = "CAST(sum(units_sold) AS BIGINT)"
TIER_NO = "CASE loyalty_tier WHEN 'Bronze' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Gold' THEN 3 WHEN 'Platinum' THEN 4 END"
SEGMENT_NO = """CASE rfm_segment WHEN 'Champions' THEN 1 WHEN 'Loyal' THEN 2 WHEN 'Potential Loyalist' THEN 3
    WHEN 'At Risk' THEN 4 WHEN 'Lost' THEN 5 END"""
TIERS = "(VALUES ('Bronze'), ('Silver'), ('Gold'), ('Platinum')) tiers(loyalty_tier)"
PREMIUM = "CASE WHEN is_premium THEN 'Premium' ELSE 'Non-Premium' END"


def _histogram(table: str, value: str, bins: int) -> str:
    return _with(table, f"""
        v AS (SELECT CAST({value} AS DOUBLE) AS x FROM {table} WHERE {value} IS NOT NULL),
        s AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                     CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
        edges AS (SELECT b AS bin, lo + (b - 1) * ((hi - lo) / {bins}) AS lower,
                         CASE WHEN b = {bins} THEN hi ELSE lo + b * ((hi - lo) / {bins}) END AS upper
                  FROM generate_series(1, {bins}) g(b), s)""", f"""
        SELECT bin, lower, upper,
               (SELECT count(*) FROM v WHERE x >= lower AND (x < upper OR bin = {bins})) AS row_count
        FROM edges ORDER BY bin""")


def _with(tables: str, extra: str, body: str) -> str:
    return over(tables, f", {extra} {body}")


AB = f"""
    SELECT experiment_group, count(DISTINCT session_id) AS sessions, count(DISTINCT customer_id) AS users,
           {n_of("purchase")} AS purchases, {n_of("bounce")} AS bounces,
           {mean("session_duration_sec")} AS avg_session_sec,
           {half_even(ratio(n_of("purchase"), "count(DISTINCT session_id)"), 4)} AS conversion_rate,
           {half_even(ratio(n_of("bounce"), "count(DISTINCT session_id)"), 4)} AS bounce_rate
    FROM clicks WHERE experiment_group IS NOT NULL GROUP BY experiment_group"""

SQL_REPORTS = {
    "q01_monthly_revenue": over("transactions", f"""
        SELECT month, count(transaction_id) AS orders, {NET} AS net_revenue, {GROSS} AS gross_revenue,
               {half_up(mean("net_revenue"), 2)} AS aov, {REFUNDS} AS refunds
        FROM transactions GROUP BY month ORDER BY month"""),
    "q02_revenue_by_channel": over("transactions campaigns", f"""
        SELECT channel, count(DISTINCT transaction_id) AS orders, count(DISTINCT customer_id) AS unique_customers,
               {half_up(NET, 2)} AS net_revenue, {half_up(mean("net_revenue"), 2)} AS avg_order_value,
               {REFUNDS} AS refunds
        FROM transactions JOIN campaigns USING (campaign_id) WHERE campaign_id <> 0
        GROUP BY channel ORDER BY net_revenue DESC"""),
    "q03_top10_campaigns": over("perf", f"""
        SELECT campaign_id, channel, objective, target_segment, duration_days, tx_count AS orders,
               {half_up("perf.net_revenue", 2)} AS net_revenue, {half_up("perf.conversion_rate", 4)} AS conversion_rate,
               {half_up("perf.bounce_rate", 4)} AS bounce_rate,
               {half_up("perf.revenue_per_visitor", 2)} AS revenue_per_visitor
        FROM perf WHERE perf.net_revenue IS NOT NULL ORDER BY perf.net_revenue DESC, campaign_id LIMIT 10"""),
    "q04_objective_comparison": over("perf", f"""
        SELECT objective, count(*) AS campaigns, {half_up(mean("net_revenue"), 2)} AS avg_net_revenue,
               {half_up(mean_rate("conversion_rate"), 4)} AS avg_conversion_rate,
               {half_up("avg(expected_uplift)", 4)} AS avg_expected_uplift,
               {half_up(mean("duration_days"), 1)} AS avg_duration_days
        FROM perf GROUP BY objective ORDER BY avg_net_revenue DESC"""),
    "q05_ab_groups": over("clicks", f"""
        SELECT experiment_group, count(DISTINCT session_id) AS sessions,
               count(DISTINCT customer_id) AS unique_users, {n_of("purchase")} AS purchases,
               {n_of("bounce")} AS bounces,
               {half_up(ratio(n_of("purchase"), "count(DISTINCT session_id)"), 4)} AS conversion_rate,
               {half_up(mean("session_duration_sec"), 1)} AS avg_session_sec
        FROM clicks GROUP BY experiment_group ORDER BY conversion_rate DESC"""),
    "q06_loyalty_tier": over("c360", f"""
        SELECT loyalty_tier, count(*) AS customers, count(*) FILTER (WHERE has_purchased) AS buyers,
               {half_up(mean("total_revenue"), 2)} AS avg_ltv, {half_up(mean("total_orders"), 2)} AS avg_orders,
               {half_up("avg(avg_order_value)", 2)} AS avg_aov,
               {half_up(mean("recency_days"), 1)} AS avg_recency_days
        FROM c360 GROUP BY loyalty_tier ORDER BY {TIER_NO}"""),
    "q07_rfm_distribution": over("c360", f"""
        SELECT rfm_segment, count(*) AS customers, {half_up(mean("total_revenue"), 2)} AS avg_revenue,
               {half_up(mean("total_orders"), 2)} AS avg_orders,
               {half_up(mean("recency_days"), 1)} AS avg_recency_days
        FROM c360 WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment ORDER BY avg_revenue DESC"""),
    "q08_acquisition_month_channel": over("customers", """
        SELECT strftime(signup_date, '%Y-%m') AS signup_month, acquisition_channel, count(*) AS new_customers
        FROM customers GROUP BY signup_month, acquisition_channel ORDER BY signup_month, new_customers DESC"""),
    "q09_country_breakdown": over("c360", f"""
        SELECT country, count(*) AS customers, {half_up("CAST(sum(total_revenue) AS DOUBLE)", 2)} AS total_revenue,
               {half_up(mean("total_revenue"), 2)} AS avg_ltv, {half_up(mean("total_orders"), 2)} AS avg_orders
        FROM c360 WHERE has_purchased GROUP BY country ORDER BY total_revenue DESC"""),
    "q10_top10_products": over("prod", f"""
        SELECT product_id, category, brand, {half_up("prod.base_price", 2)} AS base_price, is_premium, units_sold,
               {half_up("prod.total_revenue", 2)} AS total_revenue,
               {half_up("prod.avg_revenue_per_tx", 2)} AS avg_revenue_per_tx, unique_buyers
        FROM prod WHERE prod.total_revenue IS NOT NULL ORDER BY prod.total_revenue DESC, product_id LIMIT 10"""),
    "q11_category_revenue": over("prod", f"""
        SELECT category, count(*) AS products, {half_up(REV, 2)} AS total_revenue,
               {half_up(mean("total_revenue"), 2)} AS avg_revenue, {UNITS} AS total_units,
               {half_up("avg(discount_rate)", 4)} AS avg_discount_rate
        FROM prod GROUP BY category ORDER BY total_revenue DESC"""),
    "q12_premium_split": over("prod", f"""
        SELECT is_premium, count(*) AS products, {half_up(mean("base_price"), 2)} AS avg_base_price,
               {half_up(REV, 2)} AS total_revenue, {UNITS} AS total_units,
               {half_up("avg(avg_revenue_per_tx)", 2)} AS avg_revenue_per_tx
        FROM prod GROUP BY is_premium ORDER BY is_premium DESC"""),
    "q13_funnel_all": over("funnel", "SELECT * EXCLUDE (no) FROM funnel ORDER BY no"),
    "q14_funnel_by_device": over("clicks", f"""
        SELECT device_type, {n_of("view")} AS views, {n_of("click")} AS clicks, {n_of("add_to_cart")} AS add_to_carts,
               {n_of("purchase")} AS purchases,
               {half_up(ratio(n_of("purchase"), n_of("view")), 4)} AS view_to_purchase_rate
        FROM clicks WHERE device_type IS NOT NULL GROUP BY device_type ORDER BY view_to_purchase_rate DESC"""),
    "q15_funnel_by_source": over("clicks", f"""
        SELECT traffic_source, {n_of("view")} AS views, {n_of("add_to_cart")} AS add_to_carts,
               {n_of("purchase")} AS purchases, {half_up(ratio(n_of("purchase"), n_of("view")), 4)} AS conversion_rate
        FROM clicks GROUP BY traffic_source ORDER BY conversion_rate DESC"""),
    "q16_cohort_retention": over("customers transactions", """
        SELECT strftime(cohort_month, '%Y-%m') AS cohort, CAST(months AS INT) AS months_since_signup, customers
        FROM (SELECT date_trunc('month', c.signup_date) AS cohort_month,
                     date_diff('month', date_trunc('month', c.signup_date), date_trunc('month', t.ts)) AS months,
                     count(DISTINCT c.customer_id) AS customers
              FROM customers c JOIN transactions t ON c.customer_id = t.customer_id
              WHERE NOT t.refund_flag GROUP BY 1, 2)
        WHERE months BETWEEN 0 AND 11 ORDER BY cohort, months_since_signup"""),
}

EDA = {
    "eda_age_histogram": _histogram("customers", "age", 30),
    "eda_tier_counts": over("customers", f"""
        SELECT tiers.loyalty_tier, count(customer_id) AS row_count
        FROM {TIERS} LEFT JOIN customers ON customers.loyalty_tier = tiers.loyalty_tier
        GROUP BY tiers.loyalty_tier"""),
    "eda_event_counts": over("clicks", """
        SELECT event_type, count(*) AS row_count FROM clicks GROUP BY event_type ORDER BY row_count DESC"""),
    "eda_revenue_histogram": _histogram("transactions", "least(greatest(gross_revenue, -200), 600)", 50),
    "eda_quantity_counts": over("transactions", """
        SELECT quantity, count(*) AS row_count FROM transactions WHERE gross_revenue IS NOT NULL
        GROUP BY quantity ORDER BY quantity"""),
    "eda_category_counts": over("products", """
        SELECT category, count(*) AS row_count FROM products GROUP BY category ORDER BY row_count DESC"""),
    "eda_monthly": over("transactions", f"""
        SELECT month, count(transaction_id) AS orders, {NET} AS revenue FROM transactions
        GROUP BY month ORDER BY month"""),
}

CHANNELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SIGNUP_COLUMNS = ", ".join(f"count(*) FILTER (WHERE acquisition_channel = '{c}') AS \"{c}\"" for c in CHANNELS)
ACQUISITION = over("c360", f"""
    SELECT acquisition_channel, count(*) AS customers, {half_even(mean("total_revenue"), 2)} AS avg_ltv,
           {half_even(mean("total_orders"), 2)} AS avg_orders
    FROM c360 WHERE has_purchased GROUP BY acquisition_channel ORDER BY avg_ltv DESC""")
TOP_COUNTRIES = over("c360", f"""
    SELECT country, {REV} AS total_revenue FROM c360 WHERE has_purchased AND country IS NOT NULL
    GROUP BY country ORDER BY total_revenue DESC, country LIMIT 10""")

CUSTOMERS = {
    "cust_segment_share": over("c360", f"""
        SELECT rfm_segment, count(*) AS customers,
               {half_even(ratio("count(*)", "sum(count(*)) OVER ()") + " * 100", 1)} AS pct
        FROM c360 WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment ORDER BY customers DESC"""),
    "cust_ltv_by_segment": over("c360", f"""
        SELECT rfm_segment, {mean("total_revenue")} AS avg_ltv FROM c360 WHERE rfm_segment IS NOT NULL
        GROUP BY rfm_segment ORDER BY avg_ltv DESC"""),
    "cust_ltv_gap": _with("c360", f"""
        m AS (SELECT {mean("CASE WHEN rfm_segment = 'Champions' THEN total_revenue END")} AS best,
                     {mean("CASE WHEN rfm_segment = 'Lost' THEN total_revenue END")} AS worst FROM c360)""",
        f"SELECT {half_even(ratio('best', 'worst'), 1)} AS ltv_gap FROM m"),
    "cust_tier_performance": over("c360", f"""
        SELECT tiers.loyalty_tier, {half_even(mean("c360.total_revenue"), 2)} AS total_revenue,
               {half_even(mean("c360.total_orders"), 2)} AS total_orders,
               {half_even("avg(c360.avg_order_value)", 2)} AS avg_order_value
        FROM {TIERS} LEFT JOIN c360 ON c360.loyalty_tier = tiers.loyalty_tier AND has_purchased
        GROUP BY tiers.loyalty_tier"""),
    "cust_acquisition_perf": ACQUISITION,
    "cust_signup_pivot": over("customers", f"""
        SELECT strftime(signup_date, '%Y-%m') AS signup_month, {SIGNUP_COLUMNS}
        FROM customers WHERE signup_date IS NOT NULL GROUP BY signup_month ORDER BY signup_month"""),
    "cust_signup_counts": over("customers", """
        SELECT strftime(signup_date, '%Y-%m') AS signup_month, acquisition_channel, count(*) AS customers
        FROM customers WHERE signup_date IS NOT NULL AND acquisition_channel IS NOT NULL
        GROUP BY signup_month, acquisition_channel"""),
    "cust_country_top10": TOP_COUNTRIES,
}

# Cells: control and variant, sessions with a purchase and without one.
CELLS = """
    cells AS (SELECT max(purchases) FILTER (WHERE experiment_group = 'Control') AS cp,
                     max(sessions - purchases) FILTER (WHERE experiment_group = 'Control') AS cn,
                     max(purchases) FILTER (WHERE experiment_group = 'Variant_A') AS vp,
                     max(sessions - purchases) FILTER (WHERE experiment_group = 'Variant_A') AS vn
              FROM ab)"""
# Sum over the four cells of (|observed - expected| - correction)^2 / expected.
EXPECTED = [("cp", "cp + cn", "cp + vp"), ("cn", "cp + cn", "cn + vn"),
            ("vp", "vp + vn", "cp + vp"), ("vn", "vp + vn", "cn + vn")]
CHI2 = " + ".join(
    "(abs({o} - {e}) - least(0.5, abs({o} - {e}))) ** 2 / {e}".format(o=o, e=f"(({r}) * ({c}) / total)")
    for o, r, c in EXPECTED
)
# Upper tail 1 - erf(x) with x = sqrt(chi2 / 2), by the power series of erf.
P_VALUE = """CASE WHEN chi2 > 32 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * (
    SELECT sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * sqrt(chi2 / 2) ** (2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))
    FROM generate_series(0, 90) g(k)) END"""
CHI_TEST = _with("clicks", f"""
    ab AS ({AB}), {CELLS},
    counted AS (SELECT *, CAST(cp + cn + vp + vn AS DOUBLE) AS total FROM cells),
    stat AS (SELECT *, CASE WHEN least(cp, cn, vp, vn) >= 0 THEN {CHI2} END AS chi2 FROM counted),
    tested AS (SELECT *, {P_VALUE} AS p FROM stat)""", f"""
    SELECT cp AS control_purchases, cp + cn AS control_sessions, vp AS variant_purchases,
           vp + vn AS variant_sessions, 'Control' AS control_group, 'Variant_A' AS variant_group,
           {half_even("chi2", 3)} AS chi2, {half_even("p", 4)} AS p_value, p < 0.05 AS significant
    FROM tested""")
CAMPAIGNS = {
    "camp_channel_summary": over("perf", f"""
        SELECT channel, count(campaign_id) AS campaigns, {half_even(NET, 4)} AS total_revenue,
               {half_even(mean_rate("conversion_rate"), 4)} AS avg_conversion,
               {half_even(mean_rate("bounce_rate"), 4)} AS avg_bounce
        FROM perf GROUP BY channel ORDER BY total_revenue DESC"""),
    "camp_efficiency_points": over("perf", """
        SELECT campaign_id, channel, bounce_rate, conversion_rate, CAST(net_revenue AS DOUBLE) AS net_revenue
        FROM perf"""),
    "camp_objective_summary": over("perf", f"""
        SELECT objective, count(campaign_id) AS campaigns, {half_even(mean("net_revenue"), 4)} AS avg_revenue,
               {half_even(mean_rate("conversion_rate"), 4)} AS avg_conversion,
               {half_even("avg(expected_uplift)", 4)} AS avg_expected_uplift
        FROM perf GROUP BY objective ORDER BY avg_revenue DESC"""),
    "ab_summary": over("clicks", AB + " ORDER BY experiment_group"),
    "ab_chi2": CHI_TEST,
    "camp_uplift": over("perf", """
        SELECT campaign_id, channel, CAST(net_revenue AS DOUBLE) AS net_revenue, expected_uplift,
               roi AS actual_uplift_proxy
        FROM perf WHERE net_revenue IS NOT NULL"""),
}

PRODUCTS_BY_REVENUE = "ORDER BY prod.total_revenue DESC, product_id LIMIT"
MONTH_REFUNDS = f"month, {REFUNDS} AS refunds, count(*) AS transactions"
REVENUE = {
    "rev_monthly": over("transactions", f"""
        SELECT month, count(transaction_id) AS orders, {NET} AS net_revenue, {GROSS} AS gross_revenue,
               {REFUNDS} AS refunds, {mean("net_revenue")} AS aov
        FROM transactions GROUP BY month ORDER BY month"""),
    "rev_discount_impact": over("transactions", f"""
        SELECT discount_applied > 0 AS discounted, count(transaction_id) AS orders,
               {half_even(mean("net_revenue"), 2)} AS avg_revenue, {half_even(mean("quantity"), 2)} AS avg_qty
        FROM transactions GROUP BY 1 ORDER BY 1"""),
    "rev_refund_rate_monthly": over("transactions", f"""
        SELECT {MONTH_REFUNDS}, {half_even(ratio(REFUNDS, "count(*)"), 4)} AS refund_rate
        FROM transactions GROUP BY month ORDER BY month"""),
    "rev_refund_rate_overall": over("transactions", f"""
        SELECT {half_even(ratio(REFUNDS, "count(*)") + " * 100", 2)} AS refund_rate_pct FROM transactions"""),
    "prod_category_summary": over("prod", f"""
        SELECT category, {half_even(REV, 2)} AS total_revenue, {UNITS} AS units_sold, count(*) AS products,
               {half_even("avg(discount_rate)", 2)} AS avg_discount_rate
        FROM prod GROUP BY category ORDER BY total_revenue DESC"""),
    "prod_top15": over("prod", f"""
        SELECT product_id, CAST(total_revenue AS DOUBLE) AS total_revenue, category, is_premium
        FROM prod {PRODUCTS_BY_REVENUE} 15"""),
    "prod_premium_summary": over("prod", f"""
        SELECT {PREMIUM} AS label, count(*) AS products, {half_even(mean("base_price"), 2)} AS avg_price,
               {half_even(REV, 2)} AS total_revenue, {UNITS} AS units_sold
        FROM prod GROUP BY is_premium ORDER BY label"""),
    "prod_premium_shares": over("prod", f"""
        SELECT {half_even(ratio("sum(total_revenue) FILTER (WHERE is_premium)", "sum(total_revenue)") + " * 100", 1)}
                   AS premium_revenue_share,
               {half_even(ratio("count(*) FILTER (WHERE is_premium)", "count(*)") + " * 100", 1)}
                   AS premium_catalogue_share
        FROM prod"""),
}

HEATMAP = over("clicks", f"""
    SELECT d AS day_of_week, {", ".join(
        f"count(event_id) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24)
    )}
    FROM (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'), ('Sunday')) w(d)
    LEFT JOIN clicks ON dayname(ts) = d GROUP BY d""")
BEHAVIOUR = {
    "funnel_display": over("funnel", """
        SELECT stage, count, drop_off_rate, conversion_from_top,
               concat(format('{:,}', count), '  (', format('{:.1f}', conversion_from_top * 100), '%)') AS caption
        FROM funnel ORDER BY no"""),
    "funnel_device_pct": over("clicks", f"""
        SELECT device_type, {", ".join(
            f"{half_even(ratio(n_of(s), n_of('view')), 4)} AS {s}" for s in ["view", "click", "add_to_cart", "purchase"]
        )}
        FROM clicks GROUP BY device_type ORDER BY device_type"""),
    "src_conversion": over("clicks", f"""
        SELECT traffic_source, {n_of("view")} AS views, {n_of("add_to_cart")} AS carts,
               {n_of("purchase")} AS purchases, {n_of("bounce")} AS bounces,
               {half_even(ratio(n_of("purchase"), n_of("view")), 4)} AS conversion_rate,
               {half_even(ratio(n_of("bounce"), f"({n_of('view')} + {n_of('bounce')})"), 4)} AS bounce_rate
        FROM clicks GROUP BY traffic_source ORDER BY conversion_rate DESC"""),
    "activity_heatmap": HEATMAP,
    "session_duration_by_page": over("clicks", f"""
        SELECT page_category, {half_even(mean("session_duration_sec"), 1)} AS mean,
               {half_even("median(CAST(session_duration_sec AS DOUBLE))", 1)} AS median,
               count(session_duration_sec) AS count
        FROM clicks GROUP BY page_category ORDER BY mean DESC"""),
}

FIGURES = f"""
    figures AS (
        SELECT {NET} AS net, count(*) AS orders, count(DISTINCT customer_id) AS buyers, {mean("net_revenue")} AS aov,
               {ratio(REFUNDS, "count(*)")} AS refund_rate, min(year) AS first_year, max(year) AS last_year,
               (SELECT count(*) FROM customers) AS customers, (SELECT count(*) FROM products) AS products,
               (SELECT count(*) FROM campaigns) AS campaigns, (SELECT count(*) FROM clicks) AS clicks,
               (SELECT {mean_rate("conversion_rate")} FROM perf) AS conversion,
               (SELECT count(*) FROM c360 WHERE rfm_segment = 'Champions') AS champions,
               (SELECT count(*) FROM c360 WHERE rfm_segment = 'Lost') AS lost,
               (SELECT count(*) FROM products WHERE is_premium) AS premium
        FROM transactions)"""
USD, USD2 = "concat('$', format('{{:,.0f}}', {0}))", "concat('$', format('{{:,.2f}}', {0}))"
COUNT, PCT = "format('{{:,}}', {0})", "concat(format('{{:.2f}}', {0} * 100), '%')"


def _kpis(rows: list[tuple[str, str, str]]) -> str:
    return _with("campaigns products perf c360 transactions clicks", FIGURES, " UNION ALL ".join(
        f"SELECT CAST({no} AS INT) AS kpi_no, '{label}' AS kpi, CAST({value} AS DOUBLE) AS value, "
        f"{shape.format(value)} AS display FROM figures"
        for no, (label, value, shape) in enumerate(rows, start=1)
    ))


XL_MONTHLY = {
    "month": "month", "orders": "count(transaction_id)", "gross_revenue": half_even(GROSS, 2),
    "net_revenue": half_even(NET, 2), "avg_order_value": half_even(mean("net_revenue"), 2), "refunds": REFUNDS,
}
DATA_TX = """transaction_id, ts AS "timestamp", customer_id, product_id, quantity,
    CAST(discount_applied AS DOUBLE) AS discount_applied, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
    CAST(net_revenue AS DOUBLE) AS net_revenue, campaign_id, refund_flag, month, year"""
WORKBOOK = {
    "xl_derive": over("transactions", 'SELECT transaction_id, ts AS "timestamp", month, year FROM transactions'),
    "xl_monthly_rev": over("transactions", f"""
        SELECT {", ".join(f"{sql} AS {name}" for name, sql in XL_MONTHLY.items())}
        FROM transactions GROUP BY month ORDER BY month"""),
    "xl_channel_rev": over("transactions campaigns", f"""
        SELECT channel, count(transaction_id) AS orders, {half_even(NET, 2)} AS net_revenue,
               count(DISTINCT customer_id) AS unique_customers, {half_even(mean("net_revenue"), 2)} AS avg_order_value
        FROM transactions LEFT JOIN (SELECT DISTINCT campaign_id, channel FROM campaigns) USING (campaign_id)
        WHERE campaign_id <> 0 AND channel IS NOT NULL GROUP BY channel ORDER BY net_revenue DESC"""),
    "xl_rfm_summary": over("c360", f"""
        SELECT rfm_segment, count(*) AS customers, {half_even(mean("total_revenue"), 2)} AS avg_ltv,
               {half_even(mean("total_orders"), 2)} AS avg_orders,
               {half_even(mean("recency_days"), 2)} AS avg_recency_days
        FROM c360 WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment ORDER BY avg_ltv DESC"""),
    "xl_acq_perf": ACQUISITION,
    "xl_country_top20": over("c360", f"""
        SELECT country, count(*) AS customers, {half_even(REV, 2)} AS total_revenue,
               {half_even(mean("c360.total_revenue"), 2)} AS avg_ltv
        FROM c360 WHERE has_purchased AND country IS NOT NULL GROUP BY country
        ORDER BY total_revenue DESC, country LIMIT 20"""),
    "xl_category_perf": over("prod", f"""
        SELECT category, count(product_id) AS products, {half_even(REV, 2)} AS total_revenue, {UNITS} AS units_sold,
               {half_even(mean("base_price"), 2)} AS avg_price
        FROM prod GROUP BY category ORDER BY total_revenue DESC"""),
    "xl_top25_products": over("prod", f"""
        SELECT product_id, category, brand, {half_even("CAST(prod.base_price AS DOUBLE)", 3)} AS base_price,
               is_premium, units_sold, {half_even("CAST(prod.total_revenue AS DOUBLE)", 3)} AS total_revenue,
               unique_buyers, {half_even("prod.discount_rate", 3)} AS discount_rate
        FROM prod WHERE prod.total_revenue > 0 {PRODUCTS_BY_REVENUE} 25"""),
    "xl_campaign_detail": over("perf", f"""
        SELECT campaign_id, channel, objective, target_segment, duration_days, tx_count,
               {half_even("CAST(perf.net_revenue AS DOUBLE)", 4)} AS net_revenue, conversion_rate, bounce_rate,
               revenue_per_visitor
        FROM perf WHERE perf.net_revenue IS NOT NULL ORDER BY perf.net_revenue DESC, campaign_id"""),
    "xl_ab_test": _with("clicks", f"ab AS ({AB})", f"""
        SELECT * REPLACE ({half_even("avg_session_sec", 2)} AS avg_session_sec) FROM ab ORDER BY experiment_group"""),
    "xl_funnel": over("funnel", """
        SELECT stage AS "Stage", count AS "Count", drop_off_rate AS "Drop Off Rate",
               conversion_from_top AS "Conversion From Top"
        FROM funnel ORDER BY no"""),
    "xl_kpis": _kpis([
        ("Total Net Revenue", "net", USD), ("Total Orders", "orders", COUNT), ("Unique Customers", "buyers", COUNT),
        ("Average Order Value", "aov", USD2), ("Refund Rate", "refund_rate", PCT),
        ("Total Customers", "customers", COUNT), ("Total Products", "products", COUNT),
        ("Total Campaigns", "campaigns", COUNT), ("Total Events", "clicks", COUNT),
        ("Avg Campaign Conversion", "conversion", PCT), ("Champions (RFM)", "champions", COUNT),
        ("Lost Customers (RFM)", "lost", COUNT),
    ]),
    "xl_header_titles": over("transactions", f"""
        SELECT {", ".join(
            f'{sql} AS "{name.replace("_", " ").title()}"' for name, sql in XL_MONTHLY.items()
        )}
        FROM transactions GROUP BY month ORDER BY month"""),
    "xl_data_sheets": over("transactions", f"""
        SELECT {DATA_TX} FROM transactions
        ORDER BY TRY_CAST(transaction_id AS DECIMAL(38,0)), transaction_id, ts, transactions.customer_id, product_id,
                 quantity LIMIT 50000"""),
    "xl_data_sheets_customers": over("customers", """
        SELECT * REPLACE (strftime(signup_date, '%Y-%m-%d') AS signup_date) FROM customers"""),
    "xl_data_sheets_campaigns": over("campaigns", """
        SELECT * REPLACE (strftime(start_date, '%Y-%m-%d') AS start_date,
                          strftime(end_date, '%Y-%m-%d') AS end_date) FROM campaigns"""),
    "xl_data_sheets_products": over("products", """
        SELECT * REPLACE (strftime(launch_date, '%Y-%m-%d') AS launch_date,
                          CAST(base_price AS DOUBLE) AS base_price) FROM products"""),
    "xl_data_sheets_customer360": over("c360", """
        SELECT customer_id, country, age, gender, loyalty_tier, acquisition_channel, total_orders,
               CAST(total_revenue AS DOUBLE) AS total_revenue, avg_order_value, recency_days, rfm_score,
               rfm_segment, has_purchased
        FROM c360"""),
}

CHARTS = {
    "png_kpis": _kpis([
        ("Net Revenue", "net", USD), ("Total Orders", "orders", COUNT), ("Unique Buyers", "buyers", COUNT),
        ("Avg Order Value", "aov", USD2), ("Refund Rate", "refund_rate", PCT),
        ("Campaigns", "campaigns", "CAST({0} AS VARCHAR)"), ("Products", "products", COUNT),
        ("Total Customers", "customers", COUNT), ("Champions (RFM)", "champions", COUNT),
        ("Avg Conversion", "conversion", PCT), ("Premium Products", "premium", COUNT),
        ("Data Span", "NULL", "concat(first_year, ' – ', last_year)"),
    ]),
    "png_monthly": over("transactions", f"""
        SELECT month, count(transaction_id) AS orders, {NET} AS net_revenue, {mean("net_revenue")} AS aov
        FROM transactions GROUP BY month ORDER BY month"""),
    "png_segment_counts": over("c360", f"""
        SELECT rfm_segment, count(*) AS customers FROM c360 WHERE rfm_segment IS NOT NULL
        GROUP BY rfm_segment ORDER BY {SEGMENT_NO}"""),
    "png_segment_ltv": over("c360", f"""
        SELECT rfm_segment, {mean("total_revenue")} AS avg_ltv FROM c360 WHERE rfm_segment IS NOT NULL
        GROUP BY rfm_segment ORDER BY {SEGMENT_NO}"""),
    "png_tier_ltv": over("c360", f"""
        SELECT tiers.loyalty_tier, {mean("c360.total_revenue")} AS avg_ltv
        FROM {TIERS} LEFT JOIN c360 ON c360.loyalty_tier = tiers.loyalty_tier AND has_purchased
        GROUP BY tiers.loyalty_tier"""),
    "png_channel_revenue": over("perf", f"""
        SELECT channel, {NET} AS net_revenue FROM perf WHERE net_revenue IS NOT NULL
        GROUP BY channel ORDER BY net_revenue DESC"""),
    "png_efficiency_points": over("perf", """
        SELECT campaign_id, bounce_rate, conversion_rate, CAST(net_revenue AS DOUBLE) AS net_revenue,
               CAST(net_revenue AS DOUBLE) / 50 + 40 AS point_size
        FROM perf WHERE net_revenue IS NOT NULL"""),
    "png_ab_conversion": _with("clicks", f"ab AS ({AB})", """
        SELECT experiment_group, conversion_rate AS conv, conversion_rate * 100 AS conv_pct,
               experiment_group = (SELECT experiment_group FROM ab
                                   ORDER BY conversion_rate DESC, experiment_group LIMIT 1) AS is_best
        FROM ab ORDER BY experiment_group"""),
    "png_category": over("prod", f"""
        SELECT category, {REV} AS total_revenue, {UNITS} AS units_sold FROM prod
        GROUP BY category ORDER BY total_revenue DESC"""),
    "png_premium_share": over("prod", f"""
        SELECT {PREMIUM} AS label, {REV} AS total_revenue, {UNITS} AS units,
               {half_even(ratio("sum(prod.total_revenue)", "(SELECT sum(total_revenue) FROM prod)") + " * 100", 1)}
                   AS share_pct
        FROM prod GROUP BY is_premium ORDER BY label"""),
    "png_funnel_pct": over("stages", """
        SELECT ['View', 'Click', 'Add to Cart', 'Purchase'][no] AS label, n AS count,
               concat(format('{:.1f}', CAST(n AS DOUBLE) / (SELECT n FROM stages WHERE no = 1) * 100), '%')
                   AS pct_of_top
        FROM stages ORDER BY no"""),
    "png_source_conversion": over("clicks", f"""
        SELECT traffic_source, {n_of("view")} AS views, {n_of("purchase")} AS purchases,
               {half_even(ratio(n_of("purchase"), f"CASE {n_of('view')} WHEN 0 THEN 1 ELSE {n_of('view')} END")
                          + " * 100", 2)} AS conv
        FROM clicks GROUP BY traffic_source ORDER BY conv"""),
    "png_heatmap": HEATMAP,
    "png_acq_ltv": over("c360", f"""
        SELECT acquisition_channel, {mean("total_revenue")} AS avg_ltv FROM c360 WHERE has_purchased
        GROUP BY acquisition_channel ORDER BY avg_ltv DESC"""),
    "png_country_top10": TOP_COUNTRIES,
    "png_refund_rate": over("transactions", f"""
        SELECT {MONTH_REFUNDS}, {ratio(REFUNDS, "count(*)")} * 100 AS rate
        FROM transactions GROUP BY month ORDER BY month"""),
    "png_discount_aov": over("transactions", f"""
        SELECT discount_applied > 0 AS discounted, {mean("net_revenue")} AS aov FROM transactions
        GROUP BY 1 ORDER BY 1"""),
    "png_top10_products": over("prod", f"""
        SELECT concat('Product ', product_id) AS label, CAST(total_revenue AS DOUBLE) AS total_revenue,
               units_sold, unique_buyers
        FROM prod WHERE total_revenue > 0 {PRODUCTS_BY_REVENUE} 10"""),
}

SQL = SQL_REPORTS | EDA | CUSTOMERS | CAMPAIGNS | REVENUE | BEHAVIOUR | WORKBOOK | CHARTS
