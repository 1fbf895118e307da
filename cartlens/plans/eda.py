"""First look at the cleaned tables: sizes, missing values, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import ratio, round_half_even, total_or_zero
from cartlens.operators.histogram import histogram
from cartlens.operators.profile import profile_all, table_sizes
from cartlens.operators.reshape import along_spine
from cartlens.plans.warehouse import Warehouse
from cartlens.vocabulary import AGE_BINS, LOYALTY_TIERS, REVENUE_BINS, REVENUE_CEILING, REVENUE_FLOOR


def sizes(w: Warehouse) -> DataFrame:
    return table_sizes(w.cleaned())


def null_percentages(w: Warehouse) -> DataFrame:
    """Share of nulls per column in percent, columns without nulls left out."""
    share = round_half_even(ratio("null_count", "row_count") * 100.0, 2)
    return (
        profile_all(w.cleaned())
        .where(F.col("null_count") > 0)
        .select("table_name", "column_name", share.alias("null_pct"))
    )


def age_histogram(w: Warehouse) -> DataFrame:
    return histogram(w.customers, F.col("age"), AGE_BINS)


def tier_counts(w: Warehouse) -> DataFrame:
    """All four tiers in order, a tier without customers with 0."""
    counts = _value_counts(w.customers, "loyalty_tier")
    return along_spine(counts, "loyalty_tier", LOYALTY_TIERS, keep_absent=True).fillna(0, ["row_count"])


def event_counts(w: Warehouse) -> DataFrame:
    return _value_counts(w.events, "event_type").orderBy(F.desc("row_count"), "event_type")


def revenue_histogram(w: Warehouse) -> DataFrame:
    """Known gross revenue, cut off at both ends of the display range."""
    clipped = F.greatest(F.least(F.col("gross_revenue"), F.lit(REVENUE_CEILING)), F.lit(REVENUE_FLOOR))
    return histogram(w.transactions, F.when(F.col("gross_revenue").isNotNull(), clipped), REVENUE_BINS)


def quantity_counts(w: Warehouse) -> DataFrame:
    return _value_counts(w.transactions, "quantity", F.col("gross_revenue").isNotNull()).orderBy("quantity")


def category_counts(w: Warehouse) -> DataFrame:
    return _value_counts(w.products, "category").orderBy(F.desc("row_count"), "category")


def monthly_orders(w: Warehouse) -> DataFrame:
    return (
        w.transactions.where(F.col("month").isNotNull())
        .groupBy("month")
        .agg(F.count("transaction_id").alias("orders"), total_or_zero("net_revenue").alias("revenue"))
        .orderBy("month")
    )


def _value_counts(df: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    kept = df if condition is None else df.where(condition)
    return kept.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


REPORTS = {
    "eda_table_sizes": sizes,
    "eda_null_pct": null_percentages,
    "eda_age_histogram": age_histogram,
    "eda_tier_counts": tier_counts,
    "eda_event_counts": event_counts,
    "eda_revenue_histogram": revenue_histogram,
    "eda_quantity_counts": quantity_counts,
    "eda_category_counts": category_counts,
    "eda_monthly": monthly_orders,
}
