"""Dates in mixed spellings, told apart by all rows of a column.

Read by themselves: ISO dates and times, the year first with slashes or dots, eight digits, and months by name
(`5 Mar 2024`, `March 5, 2024`), each with an optional time of day, also in twelve hours.

`05/03/2024` can be read day first or month first. For each separator (`/`, `.`, `-`) one pass over the column
eliminates the order that some row refutes (`25/03/2024` is no month). What is left holds for every row with this
separator. If nothing is left, if nothing was refuted and a row reads differently either way, or if a text is no
date at all, reading such a row is an error that shows examples. A null is null.

Each pattern is searched once in a text: what it gives is bound before it is used more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.columns import named, trimmed
from cartlens.vocabulary import MONTHS

# What the year-last spelling becomes in ISO order.
NUMBERS = r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4})"
YEAR_LAST = f"^{NUMBERS}$"
DAY_FIRST, MONTH_FIRST = "$4-$3-$1", "$4-$1-$3"
# What marks texts taken apart: read by themselves, or by the order that all rows tell.
ALONE, LATER = "=", r"^\?"
SEPARATORS = {"slash": "/", "dot": ".", "dash": "-"}

YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$"
DIGITS = r"^(\d{4})(\d{2})(\d{2})$"
DAY_NAMED = r"^(\d{1,2})[ -]+([A-Za-z]+)[ .,-]+(\d{4})$"
MONTH_NAMED = r"^([A-Za-z]+)[ .]+(\d{1,2})[ ,]+(\d{4})$"
CLOCK = r"(?:,? +|T)(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?: *([AaPp][Mm]))?$"


def read_time(df: DataFrame, name: str, kind: str) -> Column:
    """The column as `kind` (date or timestamp_ntz).

    A typed column is only cast. For text, each run of the plan reads this one column once more, before the rest:
    the elimination is a scalar subquery over the rows that do not read by themselves."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return named(name).cast(kind)
    text, found = named(name), spelling(df, name, kind).scalar()
    # One chain, so that a text is taken apart once. An order that nothing tells leaves its texts unread.
    ordered = _taken_apart(text)
    for label, sign in SEPARATORS.items():
        order = F.coalesce(found[label]["order"], F.lit("$0"))
        ordered = F.regexp_replace(ordered, F.lit(LATER + NUMBERS.replace("[/.-]", f"[{sign}]")), order)
    moment = F.regexp_replace(ordered, f"^{ALONE}", "").try_cast("timestamp_ntz").cast(kind)
    separator = _separator(_taken_apart(text))
    told = F.coalesce(*[F.when(separator == sign, found[label]["message"]) for label, sign in SEPARATORS.items()])
    # A text that fits nothing is cast with the message as its value, and fails like any other that is no date.
    message = F.coalesce(told, found["unreadable"])
    return F.coalesce(text.try_cast(kind), moment, F.when(text.isNotNull(), message).cast(kind))


def spelling(df: DataFrame, name: str, kind: str) -> DataFrame:
    """One row of what all dates of a text column tell: per separator the `order` they were written in, or a
    `message` why there is none, and a message on those that are no dates."""
    text = named(name)
    # Rows that cast as they stand are not taken apart. No row is filtered: a filter would do it once more.
    rest, later = F.substr(F.col("apart"), F.lit(2)), F.col("apart").startswith(F.lit("?"))

    def moment(order: str) -> Column:
        return F.when(later, F.regexp_replace(rest, "^" + NUMBERS, order).try_cast("timestamp_ntz").cast(kind))

    alone = F.when(F.col("apart").startswith(F.lit(ALONE)), rest.try_cast("timestamp_ntz"))
    open_ = F.col("text").isNotNull() & F.col("cast").isNull() & F.col("alone").isNull()
    apart = df.select(text.alias("text"), text.try_cast(kind).alias("cast"))
    apart = apart.select("text", "cast", F.when(F.col("cast").isNull(), _taken_apart(F.col("text"))).alias("apart"))
    read = apart.select(
        "text", "cast", alone.alias("alone"), _separator(F.col("apart")).alias("separator"),
        moment(DAY_FIRST).alias("by_day"), moment(MONTH_FIRST).alias("by_month"),
    ).select(F.when(open_, F.col("text")).alias("text"), "separator", "by_day", "by_month")
    by_day, by_month = F.col("by_day"), F.col("by_month")
    lost = F.col("text").isNotNull() & by_day.isNull() & by_month.isNull()

    def least(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("text")))

    def seen(sign: str) -> Column:
        here = F.col("separator") == sign
        return F.struct(
            least(here & by_day.isNotNull() & by_month.isNull()).alias("day"),
            least(here & by_day.isNull() & by_month.isNotNull()).alias("month"),
            least(here & (by_day != by_month)).alias("either"),
        )

    folded = read.agg(
        *[seen(sign).alias(label) for label, sign in SEPARATORS.items()],
        F.count_if(lost).alias("lost"), least(lost).alias("least"), F.max(F.when(lost, F.col("text"))).alias("greatest"),
    )

    def told(label: str) -> Column:
        day, month, either = [F.col(f"{label}.{field}") for field in ("day", "month", "either")]
        return F.struct(
            F.when(day.isNotNull() & month.isNull(), DAY_FIRST)
            .when(month.isNotNull() & day.isNull(), MONTH_FIRST)
            .when(day.isNull() & either.isNull(), DAY_FIRST)
            .alias("order"),
            F.when(
                day.isNotNull() & month.isNotNull(),
                F.concat(F.lit(f"{name}: day first in ["), day, F.lit("], month first in ["), month, F.lit("]")),
            )
            .when(
                day.isNull() & month.isNull() & either.isNotNull(),
                F.concat(F.lit(f"{name}: nothing tells whether day or month stands first, as in ["), either, F.lit("]")),
            )
            .alias("message"),
            F.coalesce(day, month, either).isNotNull().alias("used"),
        )

    unreadable = F.format_string(
        f"{name.replace('%', '%%')}: %d unreadable dates, such as [%s] and [%s]", F.col("lost"), F.col("least"), F.col("greatest")
    )
    return folded.select(
        F.struct(*[told(label).alias(label) for label in SEPARATORS], unreadable.alias("unreadable")).alias("found")
    )


def spelling_orders(df: DataFrame, name: str, kind: str = "timestamp_ntz") -> DataFrame:
    """The same as rows: column_name, separator, date_order (`day first`, `month first`, or null if that is not
    told). Separators have a row if some date with them reads differently by order."""
    rows = [
        F.struct(F.lit(sign).alias("separator"), F.col(f"found.{label}").alias("told"))
        for label, sign in SEPARATORS.items()
    ]
    order = F.col("told.order")
    return (
        spelling(df, name, kind)
        .select(F.inline(F.array(*rows)))
        .where("told.used")
        .select(
            F.lit(name).alias("column_name"),
            "separator",
            F.when(order == DAY_FIRST, "day first").when(order == MONTH_FIRST, "month first").alias("date_order"),
        )
    )


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """`function` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), function)[0]


def _taken_apart(text: Column) -> Column:
    """ALONE and what a text reads as by itself, in ISO order, or `?` and a date of numbers that ends in its year; both
    with the time of day in 24 hours. Null if the time or the month is none."""

    def of_date(text: Column, date: Column) -> Column:
        return F.when(date.rlike(YEAR_LAST), F.concat(F.lit("?"), date, _clock(text))).otherwise(
            F.concat(F.lit(ALONE), _year_first(date), _clock(text))
        )

    def of_text(text: Column) -> Column:
        date = F.when(text.contains(":"), F.regexp_replace(text, CLOCK, "")).otherwise(text)
        return _bound(date, lambda date: of_date(text, date))

    return _bound(trimmed(text), of_text)


def _separator(apart: Column) -> Column:
    return F.regexp_extract(apart, LATER + NUMBERS, 2)


def _clock(text: Column) -> Column:
    """The time of day in 24 hours after a space, also from twice 12 hours; empty if the text has none."""

    def read(found: Column) -> Column:
        clock, half = found["clock"], F.lower(found["half"])
        hour = F.substring_index(clock, ":", 1).try_cast("int")
        later = F.when(hour.between(1, 12), (hour % 12 + F.when(half == "pm", 12).otherwise(0)).cast("string"))
        halved = F.concat(F.lit(" "), later, F.regexp_replace(clock, r"^\d+", ""))
        return F.when(clock == "", "").when(half == "", F.concat(F.lit(" "), clock)).otherwise(halved)

    clock, half = [F.regexp_extract(text, CLOCK, no) for no in (1, 2)]
    return F.when(text.contains(":"), _bound(F.struct(clock.alias("clock"), half.alias("half")), read)).otherwise("")


def _year_first(date: Column) -> Column:
    """A date with its month by name or its year first in ISO order; others as they stand."""

    def by_name(month: Column) -> Column:
        day_named = F.regexp_replace(date, F.lit(DAY_NAMED), F.concat(F.lit("$3-"), month, F.lit("-$1")))
        return F.regexp_replace(day_named, F.lit(MONTH_NAMED), F.concat(F.lit("$3-"), month, F.lit("-$2")))

    by_number = F.regexp_replace(F.regexp_replace(date, YEAR_FIRST, "$1-$2-$3"), DIGITS, "$1-$2-$3")
    return _bound(
        F.lower(F.regexp_extract(date, "([A-Za-z]+)", 1)),
        lambda name: F.when(name == "", by_number).otherwise(_bound(_month(name), by_name)),
    )


def _month(name: Column) -> Column:
    """Number of a month from its name in small letters or at least three first letters of it, as text."""
    known = [
        F.when(F.lit(month.lower()).startswith(name), F.lit(str(no))) for no, month in enumerate(MONTHS, 1)
    ]
    return F.when(F.length(name) >= 3, F.coalesce(*known))
