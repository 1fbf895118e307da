"""Dates of mixed spellings: what one row says alone, and what all rows say together."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartlens.operators.date_spelling import read_time, spelling_orders
from tests.test_clean import cleaned

DAY = datetime.datetime(2024, 3, 5)


def frame(spark, *texts):
    return spark.createDataFrame([(text,) for text in texts], "d string")


def read(spark, *texts, kind="timestamp_ntz"):
    df = frame(spark, *texts)
    return [row.d for row in df.select(read_time(df, "d", kind).alias("d")).collect()]


@pytest.mark.parametrize("text, expected", [
    ("2024-03-05", DAY), ("2024/3/5", DAY), ("2024.03.05", DAY), ("20240305", DAY), ("5 Mar 2024", DAY),
    ("05-MAR-2024", DAY), ("March 5, 2024", DAY), ("Mar. 05 2024", DAY), (" 2024/03/05\t", DAY),
    ("2024-03-05 14:05:06", DAY.replace(hour=14, minute=5, second=6)),
    ("2024-03-05T14:05:06.25", DAY.replace(hour=14, minute=5, second=6, microsecond=250_000)),
    ("5 March 2024 2:05 pm", DAY.replace(hour=14, minute=5)), ("2024/03/05 12:00 AM", DAY),
    ("Mar 5, 2024, 12:30 PM", DAY.replace(hour=12, minute=30)), (None, None),
])
def test_read_alone(spark, text, expected):
    assert read(spark, text) == [expected]
    assert read(spark, text, kind="date") == [expected and expected.date()]


def test_order_is_told_by_the_other_rows(spark):
    march, may = datetime.date(2024, 3, 5), datetime.date(2024, 5, 3)
    assert read(spark, "05/03/2024", "25/03/2024", kind="date")[0] == march
    assert read(spark, "05/03/2024", "03/25/2024", kind="date")[0] == may
    assert read(spark, "05/05/2024", kind="date") == [datetime.date(2024, 5, 5)]
    # 30 February is none either way, 31 April is refuted as a day in April
    assert read(spark, "05/03/2024", "04/30/2024", None, "2024-01-01", kind="date")[0] == may


def test_each_separator_is_told_apart(spark):
    found = read(spark, "05/03/2024", "25/12/2023", "05.03.2024", "12.25.2023", "2024-03-05", kind="date")
    assert found == [datetime.date(2024, 3, 5), datetime.date(2023, 12, 25), datetime.date(2024, 5, 3),
                     datetime.date(2023, 12, 25), datetime.date(2024, 3, 5)]


def test_orders_as_rows(spark):
    df = frame(spark, "25/03/2024", "03.25.2024", "01-02-2024", "2024-01-01")
    assert {tuple(row) for row in spelling_orders(df, "d").collect()} == {
        ("d", "/", "day first"), ("d", ".", "month first"), ("d", "-", None)}
    assert spelling_orders(frame(spark, "2024-01-01", None), "d").collect() == []


@pytest.mark.parametrize("texts, message", [
    (["01/02/2024"], "nothing tells whether.*01/02/2024"),
    (["13/01/2024", "01/13/2024"], r"day first in \[13/01/2024\], month first in \[01/13/2024\]"),
    (["2024-01-01", "soon", "later", "x"], r"3 unreadable dates, such as \[later\] and \[x\]"),
    (["30/02/2024", "13/01/2024"], r"1 unreadable dates, such as \[30/02/2024\]"),
    (["2024/01/01 13:00 PM"], "1 unreadable dates"), (["2024/01/01 25:00"], "1 unreadable dates"),
    (["5 Foo 2024"], "1 unreadable dates"), (["Ma 5 2024"], "1 unreadable dates"), ([" "], "1 unreadable dates"),
    (["13/01-2024"], "1 unreadable dates"),
])
def test_errors_show_examples(spark, texts, message):
    with pytest.raises(Exception, match=message):
        read(spark, *texts)


def test_no_rows(spark):
    assert read(spark) == [] and read(spark, None, None) == [None, None]


def test_typed_columns_have_no_further_pass(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-05 10:00:00' AS d")
    plan = df.select(read_time(df, "d", "date").alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and df.select(read_time(df, "d", "date")).first()[0] == DAY.date()


def test_column_names_with_dots(spark):
    df = frame(spark, "25/03/2024").withColumnRenamed("d", "a.b `c`")
    assert df.select(read_time(df, "a.b `c`", "date")).first()[0] == datetime.date(2024, 3, 25)


def test_cleaned_tables(spark):
    row = cleaned(spark, "campaigns", start_date="25/03/2024", end_date="April 2, 2024")
    assert (row.start_date, row.duration_days) == (datetime.date(2024, 3, 25), 8)
    row = cleaned(spark, "transactions", timestamp="12/31/2024 11:59:59 PM")
    assert (row.month, row.timestamp) == ("2024-12", datetime.datetime(2024, 12, 31, 23, 59, 59))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dates(datetime.date(1970, 1, 1), datetime.date(2100, 1, 1)), min_size=1, max_size=8),
       st.sampled_from("/.-"), st.booleans())
def test_any_dates_with_one_that_tells(spark, dates, sign, day_first):
    dates = [*dates, datetime.date(2024, 3, 25)]
    spelled = [f"%d{sign}%m{sign}%Y" if day_first else f"%m{sign}%d{sign}%Y"] * len(dates)
    assert read(spark, *[d.strftime(s) for d, s in zip(dates, spelled)], kind="date") == dates


def test_patterns_are_searched_once(spark):
    """However often what a pattern gives is used: the plan does not grow with it."""
    df = frame(spark, "05/03/2024", "25/03/2024")
    plan = df.select(read_time(df, "d", "timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    # The text is taken apart to be read, for the message if it cannot be, and for what all rows tell.
    assert plan.count("regexp") <= 300
