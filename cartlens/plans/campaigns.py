"""Campaign analyses and the A/B test. Half-even rounding, null groups dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import mean, mean_rate, ratio, round_half_even, total_or_zero
from cartlens.functions.stats import chi_square_2x2, chi_square_p_value
from cartlens.operators.grouping import group_with_distincts
from cartlens.plans.marts import against_median
from cartlens.plans.warehouse import Warehouse
from cartlens.vocabulary import AB_CONTROL, AB_VARIANT, SIGNIFICANCE_LEVEL


def with_revenue(w: Warehouse) -> DataFrame:
    return w.campaign_performance.where(F.col("net_revenue").isNotNull())


def channel_summary(w: Warehouse) -> DataFrame:
    return (
        w.campaign_performance.where(F.col("channel").isNotNull())
        .groupBy("channel")
        .agg(
            F.count("campaign_id").alias("campaigns"),
            round_half_even(total_or_zero("net_revenue"), 4).alias("total_revenue"),
            round_half_even(mean_rate("conversion_rate"), 4).alias("avg_conversion"),
            round_half_even(mean_rate("bounce_rate"), 4).alias("avg_bounce"),
        )
        .orderBy(F.desc("total_revenue"), "channel")
    )


def efficiency_points(w: Warehouse) -> DataFrame:
    return w.campaign_performance.select(
        "campaign_id", "channel", "bounce_rate", "conversion_rate", F.col("net_revenue").cast("double")
    )


def objective_summary(w: Warehouse) -> DataFrame:
    return (
        w.campaign_performance.where(F.col("objective").isNotNull())
        .groupBy("objective")
        .agg(
            F.count("campaign_id").alias("campaigns"),
            round_half_even(mean("net_revenue"), 4).alias("avg_revenue"),
            round_half_even(mean_rate("conversion_rate"), 4).alias("avg_conversion"),
            round_half_even(F.avg("expected_uplift"), 4).alias("avg_expected_uplift"),
        )
        .orderBy(F.col("avg_revenue").desc_nulls_last(), "objective")
    )


def ab_counts(events: DataFrame) -> DataFrame:
    """Sessions, users, purchases, bounces and mean duration per experiment group."""
    return group_with_distincts(
        events,
        ["experiment_group"],
        [
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.count_if(F.col("event_type") == "bounce").alias("bounces"),
            mean("session_duration_sec").alias("avg_session_sec"),
        ],
        {"sessions": "session_id", "users": "customer_id"},
    ).withColumns(
        {
            "conversion_rate": round_half_even(ratio("purchases", "sessions"), 4),
            "bounce_rate": round_half_even(ratio("bounces", "sessions"), 4),
        }
    )


def ab_summary(w: Warehouse) -> DataFrame:
    return ab_counts(w.events).orderBy("experiment_group")


def ab_chi_square(w: Warehouse) -> DataFrame:
    """Purchases against sessions without one, control against the first variant."""
    tested = w.events.where(F.col("experiment_group").isin(AB_CONTROL, AB_VARIANT))

    def of(group: str, column: str) -> Column:
        return F.max(F.when(F.col("experiment_group") == group, F.col(column)))

    cells = ab_counts(tested).agg(
        of(AB_CONTROL, "purchases").alias("control_purchases"),
        of(AB_CONTROL, "sessions").alias("control_sessions"),
        of(AB_VARIANT, "purchases").alias("variant_purchases"),
        of(AB_VARIANT, "sessions").alias("variant_sessions"),
    )
    statistic = chi_square_2x2(
        F.col("control_purchases"),
        F.col("control_sessions") - F.col("control_purchases"),
        F.col("variant_purchases"),
        F.col("variant_sessions") - F.col("variant_purchases"),
    )
    p_value = F.col("p_value")
    return (
        cells.withColumns(
            {"control_group": F.lit(AB_CONTROL), "variant_group": F.lit(AB_VARIANT), "chi2": statistic}
        )
        .withColumn("p_value", chi_square_p_value("chi2"))
        .withColumns(
            {
                "significant": p_value < SIGNIFICANCE_LEVEL,
                "chi2": round_half_even("chi2", 3),
                "p_value": round_half_even(p_value, 4),
            }
        )
    )


def uplift(w: Warehouse) -> DataFrame:
    """Revenue against the median campaign beside the uplift that was expected."""
    return with_revenue(w).select(
        "campaign_id",
        "channel",
        F.col("net_revenue").cast("double"),
        "expected_uplift",
        against_median(w.campaign_performance).alias("actual_uplift_proxy"),
    )


REPORTS = {
    "camp_channel_summary": channel_summary,
    "camp_efficiency_points": efficiency_points,
    "camp_objective_summary": objective_summary,
    "ab_summary": ab_summary,
    "ab_chi2": ab_chi_square,
    "camp_uplift": uplift,
}
