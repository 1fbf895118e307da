import math

import pytest
from pyspark.sql import functions as F

from cartlens.functions import columns as c
from cartlens.functions.stats import chi_square_2x2, chi_square_p_value


def value(spark, column, **inputs):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize("x, even, up", [(0.125, 0.12, 0.13), (0.135, 0.14, 0.14), (-0.125, -0.12, -0.13),
                                         (2.0, 2.0, 2.0), (None, None, None)])
def test_two_roundings(spark, x, even, up):
    column = F.lit(x).cast("double")
    assert value(spark, c.round_half_even(column, 2)) == even
    assert value(spark, c.round_half_up(column, 2)) == up


def test_ratio_is_null_on_zero(spark):
    assert value(spark, c.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, c.ratio(F.lit(1), F.lit(4))) == 0.25


@pytest.mark.parametrize("start, end, days", [
    ("2024-01-01 23:00:00", "2024-01-02 01:00:00", 0),
    ("2024-01-01 23:00:00", "2024-01-02 23:00:00", 1),
    ("2024-01-01 00:00:00", "2024-12-31 00:00:00", 365),
])
def test_whole_days_are_full_24_hours(spark, start, end, days):
    column = c.whole_days(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    assert value(spark, column) == days


@pytest.mark.parametrize("score, segment", [(15, "Champions"), (13, "Champions"), (12, "Loyal"), (10, "Loyal"),
                                            (9, "Potential Loyalist"), (7, "Potential Loyalist"), (6, "At Risk"),
                                            (5, "At Risk"), (4, "Lost"), (3, "Lost"), (None, None)])
def test_segments(spark, score, segment):
    assert value(spark, c.segment_of(F.lit(score).cast("int"))) == segment


def test_texts(spark):
    assert value(spark, c.dollars(F.lit(1234567.891), 2)) == "$1,234,567.89"
    assert value(spark, c.percent_text(F.lit(12.3456), 1)) == "1234.6%"
    day = F.lit("2024-05-09").cast("date")
    assert [value(spark, f(day)) for f in (c.month_of, c.quarter_of, c.iso_day, c.weekday_name, c.month_name)] == [
        "2024-05", "2024Q2", "2024-05-09", "Thursday", "May"]


def test_tier_rank(spark):
    assert [value(spark, c.tier_rank(F.lit(t))) for t in ("Bronze", "Platinum", "Diamond")] == [1, 4, None]


def chi(spark, *cells):
    statistic = chi_square_2x2(*[F.lit(cell) for cell in cells])
    row = spark.range(1).select(statistic.alias("x")).select("x", chi_square_p_value("x").alias("p")).first()
    return row.x, row.p


def test_chi_square_with_correction(spark):
    # By hand: [[10, 20], [20, 10]], every expected count 15, (|10-15|-0.5)^2/15 * 4.
    x, p = chi(spark, 10, 20, 20, 10)
    assert x == pytest.approx(4 * 4.5**2 / 15)
    assert p == pytest.approx(math.erfc(math.sqrt(x / 2)))
    assert chi(spark, 10, 10, 10, 10) == (0.0, 1.0)
    # The correction never turns a small gap negative.
    assert chi(spark, 10, 11, 10, 10)[0] == pytest.approx(0.0)


def test_chi_square_undefined(spark):
    assert chi(spark, 10, -1, 5, 5) == (None, None)
    assert chi(spark, 0, 0, 5, 5) == (None, None)


def test_known_p_value(spark):
    row = spark.sql("SELECT 3.841458820694124D AS x").select(chi_square_p_value("x").alias("p")).first()
    assert row.p == pytest.approx(0.05, abs=1e-9)
