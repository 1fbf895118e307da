"""Chi-square test of a 2x2 table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Statistic of [[a, b], [c, d]] with the continuity correction for one degree of freedom.

    Null when a cell is negative or a row or column total is zero.
    """
    a, b, c, d = (cell.cast("double") for cell in (a, b, c, d))
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    # The correction is half a count per cell, but never more than the gap itself.
    corrected = gap - F.least(n / 2, gap)
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    statistic = F.try_divide(n * corrected * corrected, margins)
    return F.when(F.least(a, b, c, d) >= 0, statistic)


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(statistic: pd.Series) -> pd.Series:
    """Upper tail for one degree of freedom; Spark has no error function. Used on one result row."""
    return statistic.map(lambda x: math.erfc(math.sqrt(x / 2)), na_action="ignore")
