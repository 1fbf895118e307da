"""Customer analyses: segments, lifetime value, tiers, acquisition, countries.

Half-even rounding, null groups dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.columns import mean, month_of, ratio, round_half_even, total_or_zero
from cartlens.operators.reshape import along_spine, count_matrix
from cartlens.plans.warehouse import Warehouse
from cartlens.vocabulary import LOWEST_SEGMENT, LOYALTY_TIERS, SEGMENTS


def segmented(w: Warehouse) -> DataFrame:
    return w.customer_360.where(F.col("rfm_segment").isNotNull())


def buyers_by(w: Warehouse, column: str) -> DataFrame:
    return w.customer_360.where(F.col("has_purchased") & F.col(column).isNotNull())


def segment_share(w: Warehouse) -> DataFrame:
    # The window spans the segments (five rows), not the customers.
    everyone = F.sum("customers").over(Window.partitionBy())
    return (
        segmented(w)
        .groupBy("rfm_segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("pct", round_half_even(ratio(F.col("customers"), everyone) * 100.0, 1))
        .orderBy(F.desc("customers"), "rfm_segment")
    )


def ltv_by_segment(w: Warehouse) -> DataFrame:
    return (
        segmented(w)
        .groupBy("rfm_segment")
        .agg(mean("total_revenue").alias("avg_ltv"))
        .orderBy(F.col("avg_ltv").desc_nulls_last(), "rfm_segment")
    )


def ltv_gap(w: Warehouse) -> DataFrame:
    """Mean lifetime value of the best segment as a multiple of the worst one's."""

    def segment_mean(segment: str) -> Column:
        return mean(F.when(F.col("rfm_segment") == segment, F.col("total_revenue")))

    best = SEGMENTS[0]
    return w.customer_360.agg(segment_mean(best).alias("best"), segment_mean(LOWEST_SEGMENT).alias("worst")).select(
        round_half_even(ratio("best", "worst"), 1).alias("ltv_gap")
    )


def tier_performance(w: Warehouse) -> DataFrame:
    """All four tiers in order, with nulls for a tier nobody bought in."""
    means = (
        buyers_by(w, "loyalty_tier")
        .groupBy("loyalty_tier")
        .agg(
            round_half_even(mean("total_revenue"), 2).alias("total_revenue"),
            round_half_even(mean("total_orders"), 2).alias("total_orders"),
            round_half_even(F.avg("avg_order_value"), 2).alias("avg_order_value"),
        )
    )
    return along_spine(means, "loyalty_tier", LOYALTY_TIERS, keep_absent=True)


def acquisition_performance(w: Warehouse) -> DataFrame:
    return (
        buyers_by(w, "acquisition_channel")
        .groupBy("acquisition_channel")
        .agg(
            F.count("customer_id").alias("customers"),
            round_half_even(mean("total_revenue"), 2).alias("avg_ltv"),
            round_half_even(mean("total_orders"), 2).alias("avg_orders"),
        )
        .orderBy(F.col("avg_ltv").desc_nulls_last(), "acquisition_channel")
    )


def signup_counts(w: Warehouse) -> DataFrame:
    """Sign-ups per month and channel, the long form of the matrix below."""
    return (
        w.customers.select(month_of("signup_date").alias("signup_month"), "acquisition_channel", "customer_id")
        .where(F.col("signup_month").isNotNull() & F.col("acquisition_channel").isNotNull())
        .groupBy("signup_month", "acquisition_channel")
        .agg(F.count("customer_id").alias("customers"))
    )


def signup_matrix(w: Warehouse) -> DataFrame:
    """Sign-up month by acquisition channel. A matrix needs its column names before it runs: they are
    the channels found in the customers, a short list fetched ahead. With more channels than Spark
    takes as columns this is an error; `signup_counts` has no such limit."""
    signups = w.customers.select(month_of("signup_date").alias("signup_month"), "acquisition_channel").where(
        F.col("signup_month").isNotNull() & F.col("acquisition_channel").isNotNull()
    )
    most = int(w.spark.conf.get("spark.sql.pivotMaxValues"))
    found = signups.select("acquisition_channel").distinct().orderBy("acquisition_channel").take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} acquisition channels: too many for columns")
    channels = [row.acquisition_channel for row in found]
    return count_matrix(signups, "signup_month", "acquisition_channel", channels, channels).orderBy("signup_month")


def top_countries(w: Warehouse, limit: int = 10) -> DataFrame:
    return (
        buyers_by(w, "country")
        .groupBy("country")
        .agg(total_or_zero("total_revenue").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "country")
        .limit(limit)
    )


REPORTS = {
    "cust_segment_share": segment_share,
    "cust_ltv_by_segment": ltv_by_segment,
    "cust_ltv_gap": ltv_gap,
    "cust_tier_performance": tier_performance,
    "cust_acquisition_perf": acquisition_performance,
    "cust_signup_pivot": signup_matrix,
    "cust_signup_counts": signup_counts,
    "cust_country_top10": top_countries,
}
