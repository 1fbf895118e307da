"""The four marts: customer 360, campaign performance, funnel, product performance.

Facts are folded to the mart's grain before any join, so a join sees at most one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import (
    MONEY_TOTAL,
    mean,
    ratio,
    round_half_even,
    segment_of,
    whole_days,
)
from cartlens.operators.grouping import group_with_distincts
from cartlens.operators.ranking import exact_median, quantile_buckets
from cartlens.sources.stage import stage
from cartlens.vocabulary import FUNNEL_STAGES, RFM_BUCKETS


def kept() -> Column:
    return ~F.col("refund_flag")


def zero_money() -> Column:
    return F.lit(0).cast(MONEY_TOTAL)


# --- customer 360 ---------------------------------------------------------------------------


def customer_purchases(transactions: DataFrame) -> DataFrame:
    """All transactions folded to one row per customer, refunds kept apart.

    The single pass over the fact; also carries each customer's latest timestamp of any kind, so that
    the overall latest one needs no second pass. A null customer keeps its row here.
    """

    def when_kept(column: str) -> Column:
        return F.when(kept(), F.col(column))

    return transactions.groupBy("customer_id").agg(
        F.count_if(kept()).alias("kept_rows"),
        F.count(when_kept("transaction_id")).alias("total_orders"),
        F.coalesce(F.sum(when_kept("net_revenue")), zero_money()).alias("total_revenue"),
        mean(when_kept("net_revenue")).alias("avg_order_value"),
        F.coalesce(F.sum(when_kept("quantity")), F.lit(0)).alias("total_quantity"),
        F.min(when_kept("timestamp")).alias("first_purchase"),
        F.max(when_kept("timestamp")).alias("last_purchase"),
        F.count_if("refund_flag").alias("refund_count"),
        F.count_if(kept() & (F.col("discount_applied") > 0)).alias("discount_used_count"),
        F.max("timestamp").alias("latest_of_any_kind"),
    )


def customer_tx_agg(purchases: DataFrame) -> DataFrame:
    """Customers with at least one order that was not refunded."""
    return purchases.where((F.col("kept_rows") > 0) & F.col("customer_id").isNotNull()).drop(
        "kept_rows", "latest_of_any_kind"
    )


def recency_lifetime(purchases: DataFrame) -> DataFrame:
    """Adds whole days since the last purchase, up to the latest timestamp of all transactions
    (refunds included), and between first and last purchase. `purchases` should be staged."""
    latest = purchases.agg(F.max("latest_of_any_kind")).scalar()
    return (
        customer_tx_agg(purchases)
        .withColumn("latest", latest)
        .withColumn("recency_days", whole_days("last_purchase", "latest"))
        .withColumn("customer_lifetime_days", whole_days("first_purchase", "last_purchase"))
        .drop("latest")
    )


def rfm_scores(dated: DataFrame) -> DataFrame:
    """Adds r, f and m scores (1..5, 5 best) and their sum. `dated` should be a cheap view of a staged
    table: it is read twice."""
    measures = ["recency_days", "total_orders", "total_revenue"]
    bucketed = quantile_buckets(dated, measures, "customer_id", RFM_BUCKETS)
    return (
        bucketed.withColumn("r_score", RFM_BUCKETS + 1 - F.col("recency_days_bucket"))
        .withColumnsRenamed({"total_orders_bucket": "f_score", "total_revenue_bucket": "m_score"})
        .withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
        .drop("recency_days_bucket")
    )


def scored_customers(transactions: DataFrame) -> DataFrame:
    return scored_purchases(stage(customer_purchases(transactions), "customer-purchases"))


def scored_purchases(purchases: DataFrame) -> DataFrame:
    """The same from folded transactions, a stored table."""
    scored = rfm_scores(recency_lifetime(purchases))
    return scored.withColumn("rfm_segment", segment_of("rfm_score"))


def customer_event_agg(events: DataFrame) -> DataFrame:
    return group_with_distincts(
        events,
        ["customer_id"],
        [
            F.count("event_id").alias("total_events"),
            F.count_if(F.col("event_type") == "purchase").alias("purchase_events"),
            F.count_if(F.col("event_type") == "bounce").alias("bounce_events"),
            mean("session_duration_sec").alias("avg_session_duration"),
        ],
        {"total_sessions": "session_id", "devices_used": "device_type"},
    ).withColumn("conversion_rate", round_half_even(ratio("purchase_events", "total_sessions"), 4))


def customer_360(customers: DataFrame, transactions: DataFrame, events: DataFrame) -> DataFrame:
    return customer_360_of(customers, scored_customers(transactions), customer_event_agg(events))


def customer_360_of(customers: DataFrame, scored: DataFrame, event_agg: DataFrame) -> DataFrame:
    orders = F.col("total_orders")
    return (
        customers.join(scored, "customer_id", "left")
        .join(event_agg, "customer_id", "left")
        .withColumns(
            {
                "has_purchased": F.coalesce(orders > 0, F.lit(False)),
                "total_orders": F.coalesce(orders, F.lit(0)),
                "total_revenue": F.coalesce("total_revenue", zero_money()),
            }
        )
    )


# --- campaign performance -------------------------------------------------------------------


def campaign_tx_agg(transactions: DataFrame) -> DataFrame:
    """All transactions per campaign, refunds included."""
    return group_with_distincts(
        transactions,
        ["campaign_id"],
        [
            F.count("transaction_id").alias("tx_count"),
            F.coalesce(F.sum("gross_revenue"), zero_money()).alias("gross_revenue"),
            F.coalesce(F.sum("net_revenue"), zero_money()).alias("net_revenue"),
            F.count_if("refund_flag").alias("refunds"),
            mean("discount_applied").alias("avg_discount"),
        ],
        {"unique_customers": "customer_id"},
    )


def campaign_event_agg(events: DataFrame) -> DataFrame:
    return group_with_distincts(
        events,
        ["campaign_id"],
        [
            F.count("event_id").alias("impressions"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.count_if(F.col("event_type") == "bounce").alias("bounces"),
            F.count_if(F.col("event_type") == "add_to_cart").alias("add_to_carts"),
            mean("session_duration_sec").alias("avg_session_sec"),
        ],
        {"unique_visitors": "customer_id"},
    )


def campaign_rates(event_agg: DataFrame) -> DataFrame:
    """Bounces and carts over all events of the campaign, purchases over its visitors."""
    return event_agg.withColumns(
        {
            "bounce_rate": round_half_even(ratio("bounces", "impressions"), 4),
            "click_to_cart_rate": round_half_even(ratio("add_to_carts", "impressions"), 4),
            "conversion_rate": round_half_even(ratio("purchases", "unique_visitors"), 4),
        }
    )


def against_median(perf: DataFrame, value: str = "net_revenue") -> Column:
    """Relative distance of `value` to its median over `perf`, 4 digits; `perf` should be staged."""
    median = exact_median(perf, value).select("median").scalar()
    amount = F.col(value).cast("double")
    return round_half_even(F.try_divide(amount - median, median), 4)


def revenue_per_visitor() -> Column:
    return round_half_even(ratio("net_revenue", "unique_visitors"), 2)


def campaign_performance(campaigns: DataFrame, transactions: DataFrame, events: DataFrame) -> DataFrame:
    return campaign_performance_of(campaigns, campaign_tx_agg(transactions), campaign_event_agg(events))


def campaign_performance_of(campaigns: DataFrame, tx_agg: DataFrame, event_agg: DataFrame) -> DataFrame:
    joined = stage(
        campaigns.join(tx_agg, "campaign_id", "left").join(campaign_rates(event_agg), "campaign_id", "left"),
        "campaign-performance",
    )
    return joined.withColumn("roi", against_median(joined)).withColumn("revenue_per_visitor", revenue_per_visitor())


# --- funnel ---------------------------------------------------------------------------------


def funnel(events: DataFrame) -> DataFrame:
    """One row per stage in stage order: events counted, loss against the stage before, share of the
    first stage. One pass gives a single row of counts; the four result rows are unfolded from it."""
    return _funnel_rows(
        events.where(F.col("event_type").isin(FUNNEL_STAGES)).agg(
            *[F.count_if(F.col("event_type") == stage_name).alias(stage_name) for stage_name in FUNNEL_STAGES]
        )
    )


def daily_event_counts(events: DataFrame) -> DataFrame:
    """One row per day and kind of event."""
    return events.groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("number"))


def funnel_of(counts: DataFrame) -> DataFrame:
    """The funnel from `daily_event_counts`."""

    def of(stage_name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event_type") == stage_name, F.col("number"))), F.lit(0)).alias(stage_name)

    return _funnel_rows(counts.agg(*map(of, FUNNEL_STAGES)))


def _funnel_rows(counts: DataFrame) -> DataFrame:
    previous = [F.lit(None).cast("bigint"), *map(F.col, FUNNEL_STAGES)]
    rows = [
        F.struct(
            F.lit(number).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(name).alias("count"),
            round_half_even(1 - ratio(name, previous[number - 1]), 4).alias("drop_off_rate"),
            round_half_even(ratio(name, FUNNEL_STAGES[0]), 4).alias("conversion_from_top"),
        )
        for number, name in enumerate(FUNNEL_STAGES, start=1)
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy("stage_no").drop("stage_no")


# --- product performance --------------------------------------------------------------------


def product_tx_agg(transactions: DataFrame) -> DataFrame:
    return group_with_distincts(
        transactions.where(kept()),
        ["product_id"],
        [
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("units_sold"),
            F.coalesce(F.sum("net_revenue"), zero_money()).alias("total_revenue"),
            mean("net_revenue").alias("avg_revenue_per_tx"),
            F.count("transaction_id").alias("order_count"),
            mean("discount_applied").alias("discount_rate"),
        ],
        {"unique_buyers": "customer_id"},
    )


def product_performance(products: DataFrame, transactions: DataFrame) -> DataFrame:
    return product_performance_of(products, product_tx_agg(transactions))


def product_performance_of(products: DataFrame, tx_agg: DataFrame) -> DataFrame:
    return products.join(tx_agg, "product_id", "left").withColumns(
        {
            "units_sold": F.coalesce("units_sold", F.lit(0)),
            "total_revenue": F.coalesce("total_revenue", zero_money()),
        }
    )


# --- all ------------------------------------------------------------------------------------


def build_all(cleaned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    customers, transactions, events = cleaned["customers"], cleaned["transactions"], cleaned["events"]
    return {
        "customer_360": customer_360(customers, transactions, events),
        "campaign_performance": campaign_performance(cleaned["campaigns"], transactions, events),
        "funnel": funnel(events),
        "product_performance": product_performance(cleaned["products"], transactions),
    }


