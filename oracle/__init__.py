"""SQL for DuckDB that every query's result is compared with."""

from oracle import reports, tables

ORACLE: dict[str, str] = {**tables.SQL, **reports.SQL}

# Sheet sections, titled; all transactions, with their time as it is written to CSV.
_WHOLE = ORACLE["xl_data_sheets"].replace("LIMIT 50000", "")
ORACLE["report_tables"] = tables.titled(tables.values({
    "executive_summary": ORACLE["xl_kpis"], "revenue_trends": ORACLE["xl_monthly_rev"],
    "rfm_segment_performance": ORACLE["xl_rfm_summary"], "acquisition_channel_performance": ORACLE["xl_acq_perf"],
    "revenue_by_country": ORACLE["xl_country_top20"], "campaign_detail": ORACLE["xl_campaign_detail"],
    "revenue_by_channel": ORACLE["xl_channel_rev"], "ab_test": ORACLE["xl_ab_test"],
    "revenue_by_category": ORACLE["xl_category_perf"], "top_25_products": ORACLE["xl_top25_products"],
    "funnel_analysis": ORACLE["funnel"],
    "data_transactions": f"""SELECT * REPLACE (strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp") FROM ({_WHOLE})""",
    "data_customers": ORACLE["xl_data_sheets_customers"], "data_campaigns": ORACLE["xl_data_sheets_campaigns"],
    "data_products": ORACLE["xl_data_sheets_products"], "data_customer360": ORACLE["xl_data_sheets_customer360"],
}))
