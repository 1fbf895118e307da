"""The sixteen standing SQL reports. Half-up rounding, null groups kept, nulls last in every sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import (
    mean,
    mean_rate,
    month_of,
    ratio,
    round_half_up,
    tier_rank,
    total,
)
from cartlens.operators.grouping import channel_sums, group_with_distincts
from cartlens.plans.warehouse import Warehouse
from cartlens.vocabulary import COHORT_LAST_MONTH, NO_CAMPAIGN


def largest_first(column: str) -> Column:
    return F.col(column).desc_nulls_last()


def events_of(kind: str) -> Column:
    return F.count_if(F.col("event_type") == kind)


def monthly_revenue(w: Warehouse) -> DataFrame:
    return (
        w.transactions.groupBy("month")
        .agg(
            F.count("transaction_id").alias("orders"),
            total("net_revenue").alias("net_revenue"),
            total("gross_revenue").alias("gross_revenue"),
            round_half_up(mean("net_revenue"), 2).alias("aov"),
            F.count_if("refund_flag").alias("refunds"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def revenue_by_channel(w: Warehouse) -> DataFrame:
    attributed = w.transactions.where(F.col("campaign_id") != NO_CAMPAIGN)
    channels = w.campaigns.select("campaign_id", "channel")
    sums = channel_sums(attributed, channels, {"distinct_orders": "transaction_id", "unique_customers": "customer_id"})
    return sums.select(
        "channel",
        F.col("distinct_orders").alias("orders"),
        "unique_customers",
        round_half_up("net_revenue", 2).alias("net_revenue"),
        round_half_up("mean_revenue", 2).alias("avg_order_value"),
        "refunds",
    ).orderBy(largest_first("net_revenue"))


def top10_campaigns(w: Warehouse) -> DataFrame:
    """The mart holds every campaign with its description, so it is not joined with the campaigns again."""
    return (
        w.campaign_performance.where(F.col("net_revenue").isNotNull())
        .orderBy(F.desc("net_revenue"), "campaign_id")
        .limit(10)
        .select(
            "campaign_id",
            "channel",
            "objective",
            "target_segment",
            "duration_days",
            F.col("tx_count").alias("orders"),
            round_half_up("net_revenue", 2).alias("net_revenue"),
            round_half_up("conversion_rate", 4).alias("conversion_rate"),
            round_half_up("bounce_rate", 4).alias("bounce_rate"),
            round_half_up("revenue_per_visitor", 2).alias("revenue_per_visitor"),
        )
    )


def objective_comparison(w: Warehouse) -> DataFrame:
    return (
        w.campaign_performance.groupBy("objective")
        .agg(
            F.count(F.lit(1)).alias("campaigns"),
            round_half_up(mean("net_revenue"), 2).alias("avg_net_revenue"),
            round_half_up(mean_rate("conversion_rate"), 4).alias("avg_conversion_rate"),
            round_half_up(F.avg("expected_uplift"), 4).alias("avg_expected_uplift"),
            round_half_up(mean("duration_days"), 1).alias("avg_duration_days"),
        )
        .orderBy(largest_first("avg_net_revenue"))
    )


def ab_groups(w: Warehouse) -> DataFrame:
    grouped = group_with_distincts(
        w.events,
        ["experiment_group"],
        [
            events_of("purchase").alias("purchases"),
            events_of("bounce").alias("bounces"),
            round_half_up(mean("session_duration_sec"), 1).alias("avg_session_sec"),
        ],
        {"sessions": "session_id", "unique_users": "customer_id"},
        keep_null_keys=True,
    )
    return grouped.select(
        "experiment_group",
        "sessions",
        "unique_users",
        "purchases",
        "bounces",
        round_half_up(ratio("purchases", "sessions"), 4).alias("conversion_rate"),
        "avg_session_sec",
    ).orderBy(largest_first("conversion_rate"))


def loyalty_tiers(w: Warehouse) -> DataFrame:
    return (
        w.customer_360.groupBy("loyalty_tier")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if("has_purchased").alias("buyers"),
            round_half_up(mean("total_revenue"), 2).alias("avg_ltv"),
            round_half_up(mean("total_orders"), 2).alias("avg_orders"),
            round_half_up(F.avg("avg_order_value"), 2).alias("avg_aov"),
            round_half_up(mean("recency_days"), 1).alias("avg_recency_days"),
        )
        .orderBy(tier_rank("loyalty_tier").asc_nulls_last())
    )


def rfm_distribution(w: Warehouse) -> DataFrame:
    return (
        w.customer_360.where(F.col("rfm_segment").isNotNull())
        .groupBy("rfm_segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            round_half_up(mean("total_revenue"), 2).alias("avg_revenue"),
            round_half_up(mean("total_orders"), 2).alias("avg_orders"),
            round_half_up(mean("recency_days"), 1).alias("avg_recency_days"),
        )
        .orderBy(largest_first("avg_revenue"))
    )


def acquisition_by_month(w: Warehouse) -> DataFrame:
    return (
        w.customers.groupBy(month_of("signup_date").alias("signup_month"), "acquisition_channel")
        .agg(F.count(F.lit(1)).alias("new_customers"))
        .orderBy(F.col("signup_month").asc_nulls_last(), F.desc("new_customers"))
    )


def country_breakdown(w: Warehouse) -> DataFrame:
    """The mart carries each customer's country, so it is not joined with the customers again."""
    return (
        group_with_distincts(
            w.customer_360.where("has_purchased"),
            ["country"],
            [
                round_half_up(total("total_revenue"), 2).alias("total_revenue"),
                round_half_up(mean("total_revenue"), 2).alias("avg_ltv"),
                round_half_up(mean("total_orders"), 2).alias("avg_orders"),
            ],
            {"customers": "customer_id"},
            keep_null_keys=True,
        )
        .select("country", "customers", "total_revenue", "avg_ltv", "avg_orders")
        .orderBy(largest_first("total_revenue"))
    )


def top10_products(w: Warehouse) -> DataFrame:
    """The mart carries each product's description, so it is not joined with the products again."""
    return (
        w.product_performance.where(F.col("total_revenue").isNotNull())
        .orderBy(F.desc("total_revenue"), "product_id")
        .limit(10)
        .select(
            "product_id",
            "category",
            "brand",
            round_half_up("base_price", 2).alias("base_price"),
            "is_premium",
            "units_sold",
            round_half_up("total_revenue", 2).alias("total_revenue"),
            round_half_up("avg_revenue_per_tx", 2).alias("avg_revenue_per_tx"),
            "unique_buyers",
        )
    )


def category_revenue(w: Warehouse) -> DataFrame:
    return (
        w.product_performance.groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("products"),
            round_half_up(total("total_revenue"), 2).alias("total_revenue"),
            round_half_up(mean("total_revenue"), 2).alias("avg_revenue"),
            F.sum("units_sold").alias("total_units"),
            round_half_up(F.avg("discount_rate"), 4).alias("avg_discount_rate"),
        )
        .orderBy(largest_first("total_revenue"))
    )


def premium_split(w: Warehouse) -> DataFrame:
    return (
        w.product_performance.groupBy("is_premium")
        .agg(
            F.count(F.lit(1)).alias("products"),
            round_half_up(mean("base_price"), 2).alias("avg_base_price"),
            round_half_up(total("total_revenue"), 2).alias("total_revenue"),
            F.sum("units_sold").alias("total_units"),
            round_half_up(F.avg("avg_revenue_per_tx"), 2).alias("avg_revenue_per_tx"),
        )
        .orderBy(largest_first("is_premium"))
    )


def funnel_all(w: Warehouse) -> DataFrame:
    return w.funnel


def funnel_by_device(w: Warehouse) -> DataFrame:
    return (
        w.events.where(F.col("device_type").isNotNull())
        .groupBy("device_type")
        .agg(
            events_of("view").alias("views"),
            events_of("click").alias("clicks"),
            events_of("add_to_cart").alias("add_to_carts"),
            events_of("purchase").alias("purchases"),
        )
        .withColumn("view_to_purchase_rate", round_half_up(ratio("purchases", "views"), 4))
        .orderBy(largest_first("view_to_purchase_rate"))
    )


def funnel_by_source(w: Warehouse) -> DataFrame:
    return (
        w.events.groupBy("traffic_source")
        .agg(
            events_of("view").alias("views"),
            events_of("add_to_cart").alias("add_to_carts"),
            events_of("purchase").alias("purchases"),
        )
        .withColumn("conversion_rate", round_half_up(ratio("purchases", "views"), 4))
        .orderBy(largest_first("conversion_rate"))
    )


def cohort_retention(w: Warehouse) -> DataFrame:
    """Customers per sign-up month who bought again 0..11 months later.

    Purchases are folded to one row per customer and month before the join, so a customer with very
    many orders brings at most one row per month into it. Sign-ups are made unique on the placement
    the join needs anyway. With both sides unique the joined rows are counted as they are: no distinct
    count, and only the (cohort, month) totals are shuffled after the join.
    """
    cohorts = (
        w.customers.where(F.col("signup_date").isNotNull())
        .select("customer_id", F.trunc("signup_date", "MM").alias("cohort_month"))
        .repartition("customer_id")
        .distinct()
    )
    purchases = (
        w.transactions.where(~F.col("refund_flag"))
        .select("customer_id", F.trunc("timestamp", "MM").alias("purchase_month"))
        .distinct()
    )
    months = (F.year("purchase_month") - F.year("cohort_month")) * 12 + (
        F.month("purchase_month") - F.month("cohort_month")
    )
    return (
        cohorts.join(purchases, "customer_id")
        .withColumn("months_since_signup", months)
        .where(F.col("months_since_signup").between(0, COHORT_LAST_MONTH))
        .groupBy("cohort_month", "months_since_signup")
        .agg(F.count(F.lit(1)).alias("customers"))
        .select(month_of("cohort_month").alias("cohort"), "months_since_signup", "customers")
        .orderBy("cohort", "months_since_signup")
    )


REPORTS = {
    "q01_monthly_revenue": monthly_revenue,
    "q02_revenue_by_channel": revenue_by_channel,
    "q03_top10_campaigns": top10_campaigns,
    "q04_objective_comparison": objective_comparison,
    "q05_ab_groups": ab_groups,
    "q06_loyalty_tier": loyalty_tiers,
    "q07_rfm_distribution": rfm_distribution,
    "q08_acquisition_month_channel": acquisition_by_month,
    "q09_country_breakdown": country_breakdown,
    "q10_top10_products": top10_products,
    "q11_category_revenue": category_revenue,
    "q12_premium_split": premium_split,
    "q13_funnel_all": funnel_all,
    "q14_funnel_by_device": funnel_by_device,
    "q15_funnel_by_source": funnel_by_source,
    "q16_cohort_retention": cohort_retention,
}
