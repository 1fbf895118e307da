"""Hand-made dirty rows for every cleaning rule."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartlens.plans import clean
from cartlens.sources.schemas import RAW_COLUMNS, text_schema

DEFAULTS = {
    "campaigns": dict(campaign_id="1", channel="Email", objective="x", start_date="2024-01-01",
                      end_date="2024-01-11", target_segment="VIP", expected_uplift="0.1"),
    "customers": dict(customer_id="1", signup_date="2024-01-01", country="us", age="30", gender="F",
                      loyalty_tier="Gold", acquisition_channel="Paid"),
    "events": dict(event_id="1", timestamp="2024-01-01 10:30:00", customer_id="1", session_id="s", event_type="view",
                   product_id="5", device_type="mobile", traffic_source="a", campaign_id="2", page_category="p",
                   session_duration_sec="12.5", experiment_group="Control"),
    "products": dict(product_id="1", category="c", brand="b", base_price="9.99", launch_date="2024-01-01",
                     is_premium="1"),
    "transactions": dict(transaction_id="t", timestamp="2024-01-01 10:30:00", customer_id="1", product_id="5",
                         quantity="2", discount_applied="0.1", gross_revenue="50", campaign_id="2", refund_flag="0"),
}


def cleaned(spark, table, **values):
    row = DEFAULTS[table] | values
    raw = spark.createDataFrame([[row[c] for c in RAW_COLUMNS[table]]], text_schema(RAW_COLUMNS[table]))
    return clean.CLEANERS[table](raw).first()


def test_all_white_space_is_trimmed(spark):
    row = cleaned(spark, "customers", country="\t us \n", gender="\xa0F ", acquisition_channel=" a b\r\n")
    assert (row.country, row.gender, row.acquisition_channel) == ("US", "F", "a b")
    row = cleaned(spark, "events", event_type=" view\x1f", device_type="\x0bmobile")
    assert (row.event_type, row.device_type) == ("view", "mobile")


def test_unreadable_numbers(spark):
    assert cleaned(spark, "customers", age="abc").age is None
    row = cleaned(spark, "transactions", gross_revenue="x", discount_applied="x", product_id="?")
    assert (row.gross_revenue, row.net_revenue, row.discount_applied, row.product_id) == (None, None, 0, None)
    assert cleaned(spark, "products", base_price="free").base_price is None


def test_missing_campaign_is_zero(spark):
    assert cleaned(spark, "transactions", campaign_id=None).campaign_id == 0
    assert cleaned(spark, "events", campaign_id=None).campaign_id == 0
    assert cleaned(spark, "events", campaign_id="7.0").campaign_id == 7
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaned(spark, "events", campaign_id="seven")


@pytest.mark.parametrize("raw, tier", [("Bronze", "Bronze"), ("Platinum", "Platinum"), ("Diamond", None), (None, None),
                                       (" Gold", None)])
def test_loyalty_tiers(spark, raw, tier):
    assert cleaned(spark, "customers", loyalty_tier=raw).loyalty_tier == tier


@pytest.mark.parametrize("raw, flag", [("0", False), ("1", True), ("True", True), ("false", False), (None, True),
                                       ("0.0", False), ("2", True), ("maybe", True)])
def test_flags(spark, raw, flag):
    assert cleaned(spark, "transactions", refund_flag=raw).refund_flag is flag
    assert cleaned(spark, "products", is_premium=raw).is_premium is flag


def test_typed_flags(spark):
    frame = spark.sql("SELECT 1 AS product_id, 'c' AS category, 'b' AS brand, 1.5 AS base_price, "
                      "date'2024-01-01' AS launch_date, CAST(NULL AS BOOLEAN) AS is_premium")
    assert clean.clean_products(frame).first().is_premium is True


def test_net_revenue(spark):
    assert cleaned(spark, "transactions", refund_flag="1").net_revenue == 0
    assert cleaned(spark, "transactions", refund_flag="0").net_revenue == Decimal("50")
    assert cleaned(spark, "transactions", gross_revenue=None, refund_flag="1").net_revenue == 0


def test_derived_periods(spark):
    row = cleaned(spark, "events", timestamp="2024-03-10 23:59:59")
    assert (row.date, row.hour, row.day_of_week) == (datetime.date(2024, 3, 10), 23, "Sunday")
    row = cleaned(spark, "transactions", timestamp="2024-12-31 23:59:59")
    assert (row.date, row.month, row.year) == (datetime.date(2024, 12, 31), "2024-12", 2024)
    assert cleaned(spark, "campaigns").duration_days == 10


def test_bad_timestamp_is_an_error(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaned(spark, "transactions", timestamp="not-a-date")


def test_unknown_columns_are_kept(spark):
    raw = spark.sql("SELECT '1' AS product_id, 'c' AS category, 'b' AS brand, '1' AS base_price, "
                    "'2024-01-01' AS launch_date, '1' AS is_premium, 'x' AS supplier")
    assert clean.clean_products(raw).first().supplier == "x"


WHOLE = ["1", "-1", "+1", " 12 ", "12.0", "12.9999999", ".5", "1e3", "-0", "007", "9223372036854775807", "\t7", None]


def test_whole_numbers_are_read_without_decimals(spark):
    """Plain ones by themselves, all others as before by way of a decimal."""
    texts = spark.createDataFrame([(text,) for text in WHOLE], "v string")
    doubles = spark.createDataFrame([(d,) for d in (1.0, -0.0, 17.0, 1.5, -2.0, 2.9999999, 1e15, 2.0**60, None)], "v double")
    for df in (texts, doubles):
        for read in (clean._whole_number, clean._whole_number_or_null):
            by_decimal = F.col("v").cast("decimal(38,6)").cast("bigint")
            assert df.where(~read(df, "v").eqNullSafe(by_decimal)).collect() == []
            plan = df.select(read(df, "v").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
            assert "THEN try_cast(v" in plan.split("decimal(38,6)")[0]
    for text in ("x", "1.2.3", "7\x7f", "9223372036854775808"):
        odd = spark.createDataFrame([(text,)], "v string")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|NUMERIC_VALUE_OUT_OF_RANGE|CAST_OVERFLOW"):
            odd.select(clean._whole_number(odd, "v")).collect()
