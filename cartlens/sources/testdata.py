"""The five raw tables derived from the generated Parquet tables.

Some dimension values are padded or unreadable on purpose, so that the cleaners have work to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels given to the derived rows, picked by key.
CHANNELS = ["Email", "Paid Search", "Social", "Display", "Affiliate"]
OBJECTIVES = ["acquisition", "retention", "upsell", "awareness"]
TARGET_SEGMENTS = ["New", "Returning", "VIP"]
GENDERS = ["Female", "Male", "Other"]
DEVICES = ["mobile", "desktop", "tablet"]
EXPERIMENT_GROUPS = ["Control", "Variant_A", "Variant_B"]
TRAFFIC_SOURCES = ["Organic", "Direct", "Paid", "Email", "Referral"]
PAGE_CATEGORIES = ["Home", "Product", "Cart", "Checkout"]


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    return {
        "campaigns": _campaigns(read("supplier")),
        "customers": _customers(read("customer"), read("nation"), read("orders")),
        "events": _events(read("events")),
        "products": _products(read("part")),
        "transactions": _transactions(read("lineitem"), read("orders")),
    }


def _pick(labels: list[str], key: str) -> Column:
    position = (F.col(key) % len(labels) + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, labels)), position)


def _campaigns(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key * 7 % 2000).cast("int"))
    return supplier.where(key > 0).select(
        key.alias("campaign_id"),
        F.concat(F.lit(" "), _pick(CHANNELS, "s_suppkey"), F.lit("\t")).alias("channel"),
        _pick(OBJECTIVES, "s_suppkey").alias("objective"),
        start.alias("start_date"),
        F.date_add(start, (key % 60).cast("int") + 14).alias("end_date"),
        _pick(TARGET_SEGMENTS, "s_nationkey").alias("target_segment"),
        (F.col("s_acctbal") / 100000).alias("expected_uplift"),
    )


def _customers(customer: DataFrame, nation: DataFrame, orders: DataFrame) -> DataFrame:
    first_order = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.to_date(F.min("o_orderdate")).alias("signup_date")
    )
    balance = F.col("c_acctbal")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(first_order, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            "signup_date",
            F.concat(F.lit("  "), F.lower("n_name"), F.lit(" \t")).alias("country"),
            F.when(F.col("c_custkey") % 50 == 0, "unknown")
            .otherwise((F.col("c_custkey") % 60 + 18).cast("string"))
            .alias("age"),
            _pick(GENDERS, "c_custkey").alias("gender"),
            F.when(balance < 2500, "Bronze")
            .when(balance < 5000, "Silver")
            .when(balance < 7500, "Gold")
            .otherwise("Platinum")
            .alias("loyalty_tier"),
            F.col("c_mktsegment").alias("acquisition_channel"),
        )
    )


def _events(events: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "add_to_cart")
        .when(F.col("event_type") == "error", "bounce")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("customer_id"),
        (F.col("user_id") * 100 + F.day("ts")).alias("session_id"),
        kind.alias("event_type"),
        F.when(kind != "bounce", F.col("event_id") % 200).alias("product_id"),
        _pick(DEVICES, "event_id").alias("device_type"),
        _pick(TRAFFIC_SOURCES, "event_id").alias("traffic_source"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 99 + 1).alias("campaign_id"),
        _pick(PAGE_CATEGORIES, "event_id").alias("page_category"),
        F.col("value").alias("session_duration_sec"),
        _pick(EXPERIMENT_GROUPS, "user_id").alias("experiment_group"),
    )


def _products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lit(" "), F.col("p_type")).alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("string").alias("base_price"),
        F.date_add(F.lit("1994-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("launch_date"),
        (F.col("p_size") > 25).cast("int").alias("is_premium"),
    )


def _transactions(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # An order is one short row: its side is held, the lines are not sorted for the join.
    return lineitem.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount_applied"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("gross_revenue"),
        F.nullif("l_suppkey", F.lit(0)).alias("campaign_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("refund_flag"),
    )
