"""The datasets behind the report's ten charts; drawing is left to the reader's tool."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.columns import (
    dollars,
    grouped_digits,
    mean,
    percent_text,
    ratio,
    round_half_even,
    total_or_zero,
)
from cartlens.operators.reshape import along_spine
from cartlens.plans.behaviour import activity_heatmap
from cartlens.plans.campaigns import ab_counts, with_revenue
from cartlens.plans.customers import buyers_by, ltv_by_segment, segmented, top_countries
from cartlens.plans.revenue import by_month, premium_label, top_products
from cartlens.plans.sql_reports import events_of
from cartlens.plans.warehouse import Warehouse
from cartlens.plans.workbook import fact_figures, long_figures
from cartlens.vocabulary import FUNNEL_LABELS, FUNNEL_STAGES, LOYALTY_TIERS, SEGMENTS


def whole_number(column: str) -> Column:
    return F.col(column).cast("string")


def year_span() -> Column:
    return F.concat(F.col("first_year").cast("string"), F.lit(" – "), F.col("last_year").cast("string"))


# The cards of the summary chart, in order.
KPI_CARDS = [
    ("Net Revenue", "net_revenue", dollars),
    ("Total Orders", "orders", grouped_digits),
    ("Unique Buyers", "buyers", grouped_digits),
    ("Avg Order Value", "aov", partial(dollars, digits=2)),
    ("Refund Rate", "refund_rate", percent_text),
    ("Campaigns", "campaigns", whole_number),
    ("Products", "products", grouped_digits),
    ("Total Customers", "customers", grouped_digits),
    ("Champions (RFM)", "champions", grouped_digits),
    ("Avg Conversion", "conversion", percent_text),
    ("Premium Products", "premium", grouped_digits),
    ("Data Span", None, year_span),
]


def kpi_cards(w: Warehouse) -> DataFrame:
    return long_figures(fact_figures(w), KPI_CARDS)


def monthly(w: Warehouse) -> DataFrame:
    return by_month(w).select("month", "orders", "net_revenue", "aov").orderBy("month")


def segment_counts(w: Warehouse) -> DataFrame:
    counts = segmented(w).groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"))
    return along_spine(counts, "rfm_segment", SEGMENTS, keep_absent=False)


def segment_ltv(w: Warehouse) -> DataFrame:
    return along_spine(ltv_by_segment(w), "rfm_segment", SEGMENTS, keep_absent=False)


def tier_ltv(w: Warehouse) -> DataFrame:
    means = (
        buyers_by(w, "loyalty_tier").groupBy("loyalty_tier").agg(mean("total_revenue").alias("avg_ltv"))
    )
    return along_spine(means, "loyalty_tier", LOYALTY_TIERS, keep_absent=True)


def channel_revenue(w: Warehouse) -> DataFrame:
    return (
        with_revenue(w)
        .where(F.col("channel").isNotNull())
        .groupBy("channel")
        .agg(total_or_zero("net_revenue").alias("net_revenue"))
        .orderBy(F.desc("net_revenue"), "channel")
    )


def efficiency_points(w: Warehouse) -> DataFrame:
    net = F.col("net_revenue").cast("double")
    return with_revenue(w).select(
        "campaign_id", "bounce_rate", "conversion_rate", net.alias("net_revenue"), (net / 50 + 40).alias("point_size")
    )


def ab_conversion(w: Warehouse) -> DataFrame:
    """Conversion per group and whether the group is the best (the first of equals)."""
    rates = ab_counts(w.events).select("experiment_group", F.col("conversion_rate").alias("conv"))
    # The window spans the experiment groups, not the events.
    place = F.row_number().over(
        Window.partitionBy().orderBy(F.col("conv").desc_nulls_last(), F.col("experiment_group"))
    )
    return rates.select(
        "experiment_group", "conv", (F.col("conv") * 100).alias("conv_pct"), (place == 1).alias("is_best")
    ).orderBy("experiment_group")


def category(w: Warehouse) -> DataFrame:
    return (
        w.product_performance.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            total_or_zero("total_revenue").alias("total_revenue"),
            F.coalesce(F.sum("units_sold"), F.lit(0)).alias("units_sold"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def premium_share(w: Warehouse) -> DataFrame:
    # The window spans the two premium groups, not the products.
    everything = F.sum("total_revenue").over(Window.partitionBy())
    return (
        w.product_performance.where(F.col("is_premium").isNotNull())
        .groupBy(premium_label().alias("label"))
        .agg(
            total_or_zero("total_revenue").alias("total_revenue"),
            F.coalesce(F.sum("units_sold"), F.lit(0)).alias("units"),
        )
        .withColumn("share_pct", round_half_even(ratio(F.col("total_revenue"), everything) * 100.0, 1))
        .orderBy("label")
    )


def funnel_pct(w: Warehouse) -> DataFrame:
    labels = [F.lit(text) for pair in FUNNEL_LABELS.items() for text in pair]
    label = F.element_at(F.create_map(*labels), F.col("stage"))
    top = F.col("count_of_top")
    return (
        w.funnel.withColumn("count_of_top", w.funnel.agg(
            F.max(F.when(F.col("stage") == FUNNEL_STAGES[0], F.col("count")))
        ).scalar())
        .select(label.alias("label"), "count", percent_text(ratio(F.col("count"), top), 1).alias("pct_of_top"))
    )


def source_conversion(w: Warehouse) -> DataFrame:
    """Purchases per hundred views, a source without views counting as one view."""
    views = F.when(F.col("views") == 0, 1).otherwise(F.col("views"))
    return (
        w.events.where(F.col("traffic_source").isNotNull())
        .groupBy("traffic_source")
        .agg(events_of("view").alias("views"), events_of("purchase").alias("purchases"))
        .withColumn("conv", round_half_even(ratio(F.col("purchases"), views) * 100.0, 2))
        .orderBy("conv", "traffic_source")
    )


def acquisition_ltv(w: Warehouse) -> DataFrame:
    return (
        buyers_by(w, "acquisition_channel")
        .groupBy("acquisition_channel")
        .agg(mean("total_revenue").alias("avg_ltv"))
        .orderBy(F.col("avg_ltv").desc_nulls_last(), "acquisition_channel")
    )


def refund_rate(w: Warehouse) -> DataFrame:
    return (
        by_month(w)
        .select("month", "refunds", "transactions", (ratio("refunds", "transactions") * 100.0).alias("rate"))
        .orderBy("month")
    )


def discount_aov(w: Warehouse) -> DataFrame:
    return (
        w.transactions.groupBy((F.col("discount_applied") > 0).alias("discounted"))
        .agg(mean("net_revenue").alias("aov"))
        .orderBy("discounted")
    )


def top10_products(w: Warehouse) -> DataFrame:
    return top_products(w, 10, sold_only=True).select(
        F.concat(F.lit("Product "), F.col("product_id").cast("string")).alias("label"),
        F.col("total_revenue").cast("double"),
        "units_sold",
        "unique_buyers",
    )


REPORTS = {
    "png_kpis": kpi_cards,
    "png_monthly": monthly,
    "png_segment_counts": segment_counts,
    "png_segment_ltv": segment_ltv,
    "png_tier_ltv": tier_ltv,
    "png_channel_revenue": channel_revenue,
    "png_efficiency_points": efficiency_points,
    "png_ab_conversion": ab_conversion,
    "png_category": category,
    "png_premium_share": premium_share,
    "png_funnel_pct": funnel_pct,
    "png_source_conversion": source_conversion,
    "png_heatmap": activity_heatmap,
    "png_acq_ltv": acquisition_ltv,
    "png_country_top10": top_countries,
    "png_refund_rate": refund_rate,
    "png_discount_aov": discount_aov,
    "png_top10_products": top10_products,
}
