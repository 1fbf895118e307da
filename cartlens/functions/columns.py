"""Scalar and aggregate column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartlens.vocabulary import LOYALTY_TIERS, LOWEST_SEGMENT, MONTHS, SEGMENT_FLOORS, WEEKDAYS, WHITESPACE

# Money, discounts and durations are exact decimals: a total then does not depend on the order in
# which partial sums are merged, so neither do ranks and rounded means. Up to 18 digits fit a long.
MONEY = "decimal(18,4)"
EXACT = "decimal(18,6)"
MONEY_TOTAL = "decimal(28,4)"


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def trimmed(column: str | Column) -> Column:
    """The text without white space of any kind at either end."""
    return F.trim(_col(column), F.lit(WHITESPACE))


def exact(column: str | Column) -> Column:
    return _col(column).cast(EXACT)


def round_half_even(column: str | Column, digits: int) -> Column:
    """Rounding of the data-frame reports: ties go to the even neighbour (0.125 -> 0.12)."""
    scale = float(10**digits)
    return F.rint(_col(column).cast("double") * scale) / scale


def round_half_up(column: str | Column, digits: int) -> Column:
    """Rounding of the SQL reports: ties go away from zero (0.125 -> 0.13)."""
    scale = float(10**digits)
    return F.round(_col(column).cast("double") * scale) / scale


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient as a double; null where the denominator is zero or either side is null."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def total(column: str | Column) -> Column:
    """Exact sum as a double; null when every value is null."""
    return F.sum(_col(column)).cast("double")


def total_or_zero(column: str | Column) -> Column:
    """Exact sum as a double, 0 when every value is null."""
    return F.coalesce(total(column), F.lit(0.0))


def mean(column: str | Column) -> Column:
    """Exact sum over the number of non-null values, as a double."""
    return F.try_divide(F.sum(_col(column)).cast("double"), F.count(_col(column)).cast("double"))


def mean_rate(column: str | Column) -> Column:
    """Mean of a value already rounded to a few digits, free of float noise."""
    return mean(exact(column))


def number_of(condition: Column) -> Column:
    return F.count_if(condition)


def month_of(column: str | Column) -> Column:
    """'2024-05' from a date or timestamp, independent of any time zone."""
    return F.substring(F.to_date(_col(column)).cast("string"), 1, 7)


def quarter_of(column: str | Column) -> Column:
    """'2024Q2' from a date or timestamp."""
    day = _col(column)
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def iso_day(column: str | Column) -> Column:
    return F.to_date(_col(column)).cast("string")


def weekday_name(column: str | Column) -> Column:
    return _nth(WEEKDAYS, F.weekday(_col(column)) + 1)


def month_name(column: str | Column) -> Column:
    return _nth(MONTHS, F.month(_col(column)))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Complete 24-hour periods from start to end, for start <= end."""
    return F.date_part(F.lit("DAY"), _col(end) - _col(start)).cast("bigint")


def tier_rank(column: str | Column) -> Column:
    """1 for the lowest loyalty tier upwards; null for an unknown tier."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LOYALTY_TIERS)), _col(column)), F.lit(0))


def segment_of(score: str | Column) -> Column:
    """RFM segment of a summed score; null without a score."""
    score = _col(score)
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for segment, floor in SEGMENT_FLOORS.items():
        chain = chain.when(score >= floor, segment)
    return chain.otherwise(LOWEST_SEGMENT)


def grouped_digits(column: str | Column, digits: int = 0) -> Column:
    """1234567.891 -> '1,234,567.89'."""
    return F.format_number(_col(column), digits)


def dollars(column: str | Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), grouped_digits(column, digits))


def percent_text(column: str | Column, digits: int = 2) -> Column:
    """A share such as 0.0256 as '2.56%', without thousands separators."""
    number = F.translate(grouped_digits(_col(column) * 100.0, digits), ",", "")
    return F.concat(number, F.lit("%"))


def _nth(words: list[str], position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), position)


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
