"""Small hand-made cleaned tables."""

from pyspark.sql import functions as F

from cartlens.plans import clean
from cartlens.plans.warehouse import Warehouse
from cartlens.sources.schemas import RAW_COLUMNS, text_schema
from tests.test_clean import DEFAULTS


def table(spark, name, rows):
    """A cleaned table from dicts of raw text; what a dict leaves out takes a default value."""
    columns = RAW_COLUMNS[name]
    data = [[_text((DEFAULTS[name] | row)[c]) for c in columns] for row in rows]
    return clean.CLEANERS[name](spark.createDataFrame(data, text_schema(columns)))


def _text(value):
    return None if value is None else str(value)


def fixed_warehouse(spark, **tables):
    """A warehouse over given tables; asking for another one is an error."""
    return Warehouse(spark, lambda _, name: tables[name])


def rows_of(df, *columns):
    return [tuple(row) for row in df.select(*(columns or df.columns)).collect()]


def by_key(df, key, *columns):
    return {row[0]: tuple(row[1:]) for row in df.select(F.col(key), *columns).collect()}
