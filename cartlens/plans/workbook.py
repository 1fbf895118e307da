"""The tables of the report workbook, one DataFrame per sheet section.

Half-even rounding, null groups dropped. Tables are rounded first and then sorted, so rows that look
equal are ordered by their key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import (
    dollars,
    grouped_digits,
    mean,
    mean_rate,
    month_of,
    percent_text,
    ratio,
    round_half_even,
    total,
    total_or_zero,
)
from cartlens.operators.grouping import channel_sums
from cartlens.operators.ranking import first_rows
from cartlens.plans.campaigns import ab_counts, with_revenue
from cartlens.plans.customers import acquisition_performance, buyers_by, segmented
from cartlens.plans.revenue import by_month, top_products
from cartlens.plans.warehouse import Warehouse
from cartlens.sources.csv import write_all_csv
from cartlens.vocabulary import DATA_SHEET_ROWS, LOWEST_SEGMENT, NO_CAMPAIGN, SEGMENTS

# The key figures of the summary sheet and the columns of the data sheets, in order.
KPIS = [
    ("Total Net Revenue", "net_revenue", dollars),
    ("Total Orders", "orders", grouped_digits),
    ("Unique Customers", "buyers", grouped_digits),
    ("Average Order Value", "aov", partial(dollars, digits=2)),
    ("Refund Rate", "refund_rate", percent_text),
    ("Total Customers", "customers", grouped_digits),
    ("Total Products", "products", grouped_digits),
    ("Total Campaigns", "campaigns", grouped_digits),
    ("Total Events", "events", grouped_digits),
    ("Avg Campaign Conversion", "conversion", percent_text),
    ("Champions (RFM)", "champions", grouped_digits),
    ("Lost Customers (RFM)", "lost", grouped_digits),
]
DATA_TRANSACTION_COLUMNS = [
    "transaction_id", "timestamp", "customer_id", "product_id", "quantity", "discount_applied", "gross_revenue",
    "net_revenue", "campaign_id", "refund_flag", "month", "year",
]
DATA_CUSTOMER_360_COLUMNS = [
    "customer_id", "country", "age", "gender", "loyalty_tier", "acquisition_channel", "total_orders",
    "total_revenue", "avg_order_value", "recency_days", "rfm_score", "rfm_segment", "has_purchased",
]


def derived_periods(w: Warehouse) -> DataFrame:
    """Transactions with month and year derived again from the timestamp."""
    return w.transactions.select(
        "transaction_id", "timestamp", month_of("timestamp").alias("month"), F.year("timestamp").alias("year")
    )


def monthly_revenue(w: Warehouse) -> DataFrame:
    return (
        by_month(w)
        .select(
            "month",
            "orders",
            round_half_even("gross_revenue", 2).alias("gross_revenue"),
            round_half_even("net_revenue", 2).alias("net_revenue"),
            round_half_even("aov", 2).alias("avg_order_value"),
            "refunds",
        )
        .orderBy("month")
    )


def channel_revenue(w: Warehouse) -> DataFrame:
    """Transactions of no known campaign have no channel and drop out with the null group."""
    channels = w.campaigns.select("campaign_id", "channel").where(F.col("channel").isNotNull()).dropDuplicates()
    attributed = w.transactions.where(F.col("campaign_id") != NO_CAMPAIGN)
    return (
        channel_sums(attributed, channels, {"unique_customers": "customer_id"})
        .select(
            "channel",
            "orders",
            round_half_even(F.coalesce("net_revenue", F.lit(0.0)), 2).alias("net_revenue"),
            "unique_customers",
            round_half_even("mean_revenue", 2).alias("avg_order_value"),
        )
        .orderBy(F.desc("net_revenue"), "channel")
    )


def rfm_summary(w: Warehouse) -> DataFrame:
    return (
        segmented(w)
        .groupBy("rfm_segment")
        .agg(
            F.count("customer_id").alias("customers"),
            round_half_even(mean("total_revenue"), 2).alias("avg_ltv"),
            round_half_even(mean("total_orders"), 2).alias("avg_orders"),
            round_half_even(mean("recency_days"), 2).alias("avg_recency_days"),
        )
        .orderBy(F.col("avg_ltv").desc_nulls_last(), "rfm_segment")
    )


def country_revenue(w: Warehouse, limit: int = 20) -> DataFrame:
    return (
        buyers_by(w, "country")
        .groupBy("country")
        .agg(
            F.count("customer_id").alias("customers"),
            round_half_even(total_or_zero("total_revenue"), 2).alias("total_revenue"),
            round_half_even(mean("total_revenue"), 2).alias("avg_ltv"),
        )
        .orderBy(F.desc("total_revenue"), "country")
        .limit(limit)
    )


def category_performance(w: Warehouse) -> DataFrame:
    return (
        w.product_performance.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            F.count("product_id").alias("products"),
            round_half_even(total_or_zero("total_revenue"), 2).alias("total_revenue"),
            F.coalesce(F.sum("units_sold"), F.lit(0)).alias("units_sold"),
            round_half_even(mean("base_price"), 2).alias("avg_price"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def top25_products(w: Warehouse) -> DataFrame:
    return top_products(w, 25, sold_only=True).select(
        "product_id",
        "category",
        "brand",
        round_half_even("base_price", 3).alias("base_price"),
        "is_premium",
        "units_sold",
        round_half_even("total_revenue", 3).alias("total_revenue"),
        "unique_buyers",
        round_half_even("discount_rate", 3).alias("discount_rate"),
    )


def campaign_detail(w: Warehouse) -> DataFrame:
    return with_revenue(w).orderBy(F.desc("net_revenue"), "campaign_id").select(
        "campaign_id",
        "channel",
        "objective",
        "target_segment",
        "duration_days",
        "tx_count",
        round_half_even("net_revenue", 4).alias("net_revenue"),
        "conversion_rate",
        "bounce_rate",
        "revenue_per_visitor",
    )


def ab_test(w: Warehouse) -> DataFrame:
    return (
        ab_counts(w.events)
        .withColumn("avg_session_sec", round_half_even("avg_session_sec", 2))
        .orderBy("experiment_group")
    )


def funnel_titled(w: Warehouse) -> DataFrame:
    return titled(w.funnel)


def fact_figures(w: Warehouse) -> DataFrame:
    """One row of everything the key figures need. Each table is folded on its own; the single values
    reach this row as scalars, so no table is joined with another."""

    def rows(df: DataFrame):
        return df.agg(F.count(F.lit(1))).scalar()

    segments = w.customer_360.groupBy().agg(
        F.struct(
            F.count_if(F.col("rfm_segment") == SEGMENTS[0]).alias("champions"),
            F.count_if(F.col("rfm_segment") == LOWEST_SEGMENT).alias("lost"),
        )
    )
    catalogue = w.products.agg(
        F.struct(F.count(F.lit(1)).alias("products"), F.count_if("is_premium").alias("premium"))
    )
    return (
        w.transactions.agg(
            total("net_revenue").alias("net_revenue"),
            F.count(F.lit(1)).alias("orders"),
            mean("net_revenue").alias("aov"),
            ratio(F.count_if("refund_flag"), F.count("refund_flag")).alias("refund_rate"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
        .withColumns(
            {
                "segments": segments.scalar(),
                "catalogue": catalogue.scalar(),
                "buyers": rows(w.transactions.select("customer_id").where(F.col("customer_id").isNotNull()).distinct()),
                "customers": rows(w.customers),
                "campaigns": rows(w.campaigns),
                "events": rows(w.events),
                "conversion": w.campaign_performance.agg(mean_rate("conversion_rate")).scalar(),
            }
        )
        .withColumns(
            {
                "champions": F.col("segments").getField("champions"),
                "lost": F.col("segments").getField("lost"),
                "products": F.col("catalogue").getField("products"),
                "premium": F.col("catalogue").getField("premium"),
            }
        )
        .drop("segments", "catalogue")
    )


def long_figures(figures: DataFrame, rows: list[tuple[str, str | None, Callable]]) -> DataFrame:
    """kpi_no, kpi, value, display from the one-row frame and (label, column, how to show it).

    Without a column there is no value, and the display is made from the whole row.
    """
    structs = [
        F.struct(
            F.lit(number).alias("kpi_no"),
            F.lit(label).alias("kpi"),
            (F.lit(None) if column is None else F.col(column)).cast("double").alias("value"),
            (show() if column is None else show(column)).alias("display"),
        )
        for number, (label, column, show) in enumerate(rows, start=1)
    ]
    return figures.select(F.inline(F.array(*structs)))


def kpis(w: Warehouse) -> DataFrame:
    return long_figures(fact_figures(w), KPIS)


def titled(df: DataFrame) -> DataFrame:
    """Sheet headers: total_revenue -> Total Revenue."""
    return df.withColumnsRenamed({name: name.replace("_", " ").title() for name in df.columns})


def data_transactions(w: Warehouse, limit: int | None = None) -> DataFrame:
    """All transactions, or the first `limit` by id: by number where ids are whole numbers, else by text.
    Ties on the id (should it not be unique) are settled by the other columns."""
    # Text that is no number is told by its characters: a failed cast costs an exception a row.
    identifier = F.trim("transaction_id")
    number = F.when(identifier.rlike(r"^[+-]?[0-9]+$"), identifier.try_cast("decimal(38,0)"))
    return first_rows(w.transactions.select(DATA_TRANSACTION_COLUMNS), [number, *DATA_TRANSACTION_COLUMNS], limit)


def data_customers(w: Warehouse) -> DataFrame:
    return w.customers


def data_campaigns(w: Warehouse) -> DataFrame:
    return w.campaigns


def data_products(w: Warehouse) -> DataFrame:
    return w.products


def data_customer_360(w: Warehouse) -> DataFrame:
    return w.customer_360.select(DATA_CUSTOMER_360_COLUMNS)


# Sheet sections by table name, in workbook order.
SECTIONS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "executive_summary": kpis,
    "revenue_trends": monthly_revenue,
    "rfm_segment_performance": rfm_summary,
    "acquisition_channel_performance": acquisition_performance,
    "revenue_by_country": country_revenue,
    "campaign_detail": campaign_detail,
    "revenue_by_channel": channel_revenue,
    "ab_test": ab_test,
    "revenue_by_category": category_performance,
    "top_25_products": top25_products,
    "funnel_analysis": lambda w: w.funnel,
    "data_transactions": data_transactions,
    "data_customers": data_customers,
    "data_campaigns": data_campaigns,
    "data_products": data_products,
    "data_customer360": data_customer_360,
}


def write_report_tables(w: Warehouse, folder: str) -> dict[str, str]:
    """Every section as CSV with sheet headers below `folder`; the path of each by name."""
    return write_all_csv(report_tables(w), folder)


def report_tables(w: Warehouse) -> dict[str, DataFrame]:
    return {name: titled(section(w)) for name, section in SECTIONS.items()}


REPORTS = {
    "xl_derive": derived_periods,
    "xl_monthly_rev": monthly_revenue,
    "xl_channel_rev": channel_revenue,
    "xl_rfm_summary": rfm_summary,
    "xl_acq_perf": acquisition_performance,
    "xl_country_top20": country_revenue,
    "xl_category_perf": category_performance,
    "xl_top25_products": top25_products,
    "xl_campaign_detail": campaign_detail,
    "xl_ab_test": ab_test,
    "xl_funnel": funnel_titled,
    "xl_kpis": kpis,
    "xl_header_titles": lambda w: titled(monthly_revenue(w)),
    "xl_data_sheets": partial(data_transactions, limit=DATA_SHEET_ROWS),
    "xl_data_sheets_customers": data_customers,
    "xl_data_sheets_campaigns": data_campaigns,
    "xl_data_sheets_products": data_products,
    "xl_data_sheets_customer360": data_customer_360,
}
