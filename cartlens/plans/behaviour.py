"""Funnel and behaviour analyses over events. Half-even rounding, null groups dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import grouped_digits, mean, percent_text, ratio, round_half_even
from cartlens.operators.ranking import exact_median
from cartlens.operators.reshape import along_spine, count_matrix
from cartlens.plans.sql_reports import events_of
from cartlens.plans.warehouse import Warehouse
from cartlens.vocabulary import FUNNEL_STAGES, WEEKDAYS


def funnel_display(w: Warehouse) -> DataFrame:
    """The funnel with a caption per stage: '1,982  (100.0%)'."""
    caption = F.concat(
        grouped_digits("count"), F.lit("  ("), percent_text("conversion_from_top", 1), F.lit(")")
    )
    return w.funnel.withColumn("caption", caption)


def device_funnel(w: Warehouse) -> DataFrame:
    """Each stage's events as a share of the views, per device."""
    staged = w.events.where(
        F.col("event_type").isin(FUNNEL_STAGES) & F.col("device_type").isNotNull() & F.col("event_id").isNotNull()
    )
    counts = count_matrix(staged, "device_type", "event_type", FUNNEL_STAGES, FUNNEL_STAGES)
    views = FUNNEL_STAGES[0]
    return counts.select(
        "device_type", *[round_half_even(ratio(stage, views), 4).alias(stage) for stage in FUNNEL_STAGES]
    ).orderBy("device_type")


def source_conversion(w: Warehouse) -> DataFrame:
    return (
        w.events.where(F.col("traffic_source").isNotNull())
        .groupBy("traffic_source")
        .agg(
            events_of("view").alias("views"),
            events_of("add_to_cart").alias("carts"),
            events_of("purchase").alias("purchases"),
            events_of("bounce").alias("bounces"),
        )
        .withColumns(
            {
                "conversion_rate": round_half_even(ratio("purchases", "views"), 4),
                "bounce_rate": round_half_even(ratio(F.col("bounces"), F.col("views") + F.col("bounces")), 4),
            }
        )
        .orderBy(F.col("conversion_rate").desc_nulls_last(), "traffic_source")
    )


def activity_heatmap(w: Warehouse) -> DataFrame:
    """Events per weekday (Monday first, all seven) and hour, zero where none happened."""
    hours = list(range(24))
    names = [f"h{hour:02d}" for hour in hours]
    matrix = count_matrix(w.events.where(F.col("event_id").isNotNull()), "day_of_week", "hour", hours, names)
    filled = along_spine(matrix, "day_of_week", WEEKDAYS, keep_absent=True)
    return filled.fillna(0, names)


def session_duration_by_page(w: Warehouse) -> DataFrame:
    pages = w.events.where(F.col("page_category").isNotNull())
    medians = exact_median(pages, "session_duration_sec", ["page_category"])
    return (
        pages.groupBy("page_category")
        .agg(
            round_half_even(mean("session_duration_sec"), 1).alias("mean"),
            F.count("session_duration_sec").alias("count"),
        )
        .join(medians, "page_category", "left")
        .select("page_category", "mean", round_half_even("median", 1).alias("median"), "count")
        .orderBy(F.col("mean").desc_nulls_last(), "page_category")
    )


REPORTS = {
    "funnel_display": funnel_display,
    "funnel_device_pct": device_funnel,
    "src_conversion": source_conversion,
    "activity_heatmap": activity_heatmap,
    "session_duration_by_page": session_duration_by_page,
}
