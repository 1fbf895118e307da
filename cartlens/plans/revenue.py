"""Revenue and product analyses. Half-even rounding, null groups dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import mean, ratio, round_half_even, total, total_or_zero
from cartlens.plans.warehouse import Warehouse


def by_month(w: Warehouse) -> DataFrame:
    """Everything the monthly reports show, unrounded; a report selects what it needs and the rest
    is pruned from the scan."""
    return (
        w.transactions.where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(
            F.count("transaction_id").alias("orders"),
            total_or_zero("net_revenue").alias("net_revenue"),
            total_or_zero("gross_revenue").alias("gross_revenue"),
            F.count_if("refund_flag").alias("refunds"),
            F.count("refund_flag").alias("transactions"),
            mean("net_revenue").alias("aov"),
        )
    )


def monthly(w: Warehouse) -> DataFrame:
    return by_month(w).select("month", "orders", "net_revenue", "gross_revenue", "refunds", "aov").orderBy("month")


def discount_impact(w: Warehouse) -> DataFrame:
    return (
        w.transactions.groupBy((F.col("discount_applied") > 0).alias("discounted"))
        .agg(
            F.count("transaction_id").alias("orders"),
            round_half_even(mean("net_revenue"), 2).alias("avg_revenue"),
            round_half_even(mean("quantity"), 2).alias("avg_qty"),
        )
        .orderBy("discounted")
    )


def refund_rate_monthly(w: Warehouse) -> DataFrame:
    return (
        by_month(w)
        .select(
            "month",
            "refunds",
            "transactions",
            round_half_even(ratio("refunds", "transactions"), 4).alias("refund_rate"),
        )
        .orderBy("month")
    )


def refund_rate_overall(w: Warehouse) -> DataFrame:
    return w.transactions.agg(F.count_if("refund_flag").alias("refunds"), F.count("refund_flag").alias("n")).select(
        round_half_even(ratio("refunds", "n") * 100.0, 2).alias("refund_rate_pct")
    )


def category_summary(w: Warehouse) -> DataFrame:
    return (
        w.product_performance.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            round_half_even(total_or_zero("total_revenue"), 2).alias("total_revenue"),
            F.coalesce(F.sum("units_sold"), F.lit(0)).alias("units_sold"),
            F.count("product_id").alias("products"),
            round_half_even(F.avg("discount_rate"), 2).alias("avg_discount_rate"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def top_products(w: Warehouse, limit: int, sold_only: bool) -> DataFrame:
    """The products with the largest revenue; the smaller id wins a tie."""
    products = w.product_performance
    if sold_only:
        products = products.where(F.col("total_revenue") > 0)
    return products.orderBy(F.desc("total_revenue"), "product_id").limit(limit)


def top15(w: Warehouse) -> DataFrame:
    return top_products(w, 15, sold_only=False).select(
        "product_id", F.col("total_revenue").cast("double"), "category", "is_premium"
    )


def premium_summary(w: Warehouse) -> DataFrame:
    return (
        w.product_performance.where(F.col("is_premium").isNotNull())
        .groupBy("is_premium")
        .agg(
            F.count("product_id").alias("products"),
            round_half_even(mean("base_price"), 2).alias("avg_price"),
            round_half_even(total_or_zero("total_revenue"), 2).alias("total_revenue"),
            F.coalesce(F.sum("units_sold"), F.lit(0)).alias("units_sold"),
        )
        .select(
            premium_label().alias("label"), "products", "avg_price", "total_revenue", "units_sold"
        )
        .orderBy("label")
    )


def premium_label():
    return F.when(F.col("is_premium"), "Premium").otherwise("Non-Premium")


def premium_shares(w: Warehouse) -> DataFrame:
    premium = F.col("is_premium")
    return w.product_performance.agg(
        round_half_even(
            ratio(total(F.when(premium, F.col("total_revenue"))), total("total_revenue")) * 100.0, 1
        ).alias("premium_revenue_share"),
        round_half_even(ratio(F.count_if(premium), F.count("product_id")) * 100.0, 1).alias(
            "premium_catalogue_share"
        ),
    )


REPORTS = {
    "rev_monthly": monthly,
    "rev_discount_impact": discount_impact,
    "rev_refund_rate_monthly": refund_rate_monthly,
    "rev_refund_rate_overall": refund_rate_overall,
    "prod_category_summary": category_summary,
    "prod_top15": top15,
    "prod_premium_summary": premium_summary,
    "prod_premium_shares": premium_shares,
}
