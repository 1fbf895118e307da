"""Headered CSV files in and out."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.columns import named
from cartlens.operators.profile import row_sums_all
from cartlens.sources.csv_ranges import records
from cartlens.sources.jobs import side_by_side
from cartlens.sources.schemas import RAW_COLUMNS, text_schema
from cartlens.vocabulary import NULL_TOKENS


CORRUPT = "_corrupt_record"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
# Frames written at a time: small ones fill the gaps that large ones leave on the cluster.
WRITERS = 4


def scan_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Every column as text, with the usual spellings of a missing value turned into null.

    Columns are matched by the file's own header, whatever their order and whatever else the file
    holds. The schema is never inferred from the data: only the header line is read ahead.
    `multi_line` admits line breaks inside quoted fields; the text is then read twice, by as many tasks as without.

    A row with more or fewer fields than the header, or cut by a line break in quotes, is an error when it
    is read; `malformed_rows` counts and shows such rows.
    """
    frame = _records(spark, path, multi_line)
    if missing := [name for name in columns if name not in frame.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    message = F.concat(F.lit(f"malformed row in {path}: "), _malformed(frame))
    sound = F.when(_malformed(frame).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    return frame.where(sound).select([_null_token_free(name) for name in columns])


def malformed_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The rows of a file that do not fit its header, as text (`row`)."""
    frame = _records(spark, path, multi_line)
    return frame.select(_malformed(frame).alias("row")).where(F.col("row").isNotNull())


def _malformed(frame: DataFrame) -> Column:
    """The text of a malformed row. Spark does not answer from the record column alone: nothing of the first
    column is added to it."""
    nothing = F.substring(F.coalesce(named(frame.columns[0]), F.lit("")), 1, 0)
    return F.concat(F.col(CORRUPT), nothing)


def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = text_schema(_header(spark, path)).add(CORRUPT, T.StringType())
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if multi_line:
        ddl = ", ".join(f"`{field.name.replace('`', '``')}` string" for field in schema)
        parsed = F.from_csv("record", ddl, options | {"multiLine": "true"})
        return records(spark, path).select(parsed.alias("row")).select("row.*")
    return spark.read.schema(schema).options(header=True, columnPruning=False, **options).csv(path)


def scan_all_csv(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """The five raw tables from `<folder>/<table>.csv` (a file or a folder of part files)."""
    return {
        table: scan_csv(spark, f"{folder.rstrip('/')}/{table}.csv", columns, multi_line)
        for table, columns in RAW_COLUMNS.items()
    }


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of headered part files; doubled quotes, as spreadsheet and BI tools expect.

    A timestamp is written with its full time, a number in plain notation and a null as an empty field.
    """
    (
        _rendered(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", TIME_FORMAT)
        .csv(path)
    )


def write_all_csv(exports: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every frame as CSV below `folder`; the path of each by name."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in exports}
    side_by_side([partial(write_csv, df, paths[name]) for name, df in exports.items()], WRITERS)
    return paths


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A written CSV folder as text columns, an empty field as null."""
    options = {"header": True, "escape": '"', "multiLine": True}
    return spark.read.options(**options).csv(path)


def differing_csv(exports: dict[str, DataFrame], paths: dict[str, str]) -> DataFrame:
    """Of written frames those whose files hold other rows: table_name, rows, rows_in_files.

    Order-free sums of row digests, of the frame as text and of what is read back, so any value that was lost,
    changed or exchanged between rows shows. The frames are computed once more."""
    frames, files = {}, {}
    for name, df in exports.items():
        files[name] = read_text(df.sparkSession, paths[name])
        times = {f.name: F.date_format(named(f.name), TIME_FORMAT) for f in df.schema if f.dataType == T.TimestampNTZType()}
        frames[name] = _rendered(df).withColumns(times) if times else _rendered(df)
    written, found = row_sums_all(frames).alias("w"), row_sums_all(files).alias("f")
    same = (F.col("w.first_sum") == F.col("f.first_sum")) & (F.col("w.second_sum") == F.col("f.second_sum"))
    return (
        written.join(found, "table_name")
        .where(~same | (F.col("w.row_count") != F.col("f.row_count")))
        .select("table_name", F.col("w.row_count").alias("rows"), F.col("f.row_count").alias("rows_in_files"))
    )


def _rendered(df: DataFrame) -> DataFrame:
    return df.select([_plain(field) for field in df.schema])


def _plain(field: T.StructField) -> Column:
    kind = field.dataType
    # The text of a decimal of few digits has no exponent: only zeros at its end are taken off.
    if isinstance(kind, T.DecimalType) and 0 < kind.scale <= 6:
        zeros_off = F.rtrim(named(field.name).cast("string"), F.lit("0"))
        return F.rtrim(zeros_off, F.lit(".")).alias(field.name)
    return _plain_number(field.name) if isinstance(kind, T.FractionalType) else named(field.name)


def _header(spark: SparkSession, path: str) -> list[str]:
    # With a header and no data-driven inference Spark reads one line here and types nothing.
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).columns


def _plain_number(name: str) -> Column:
    """12345678.9 rather than 1.23456789E7 or 12345678.9000."""
    return F.call_function("format_number", named(name), F.lit("0." + "#" * 18)).alias(name)


def _null_token_free(name: str):
    column = F.col(name)
    return F.when(~column.isin(NULL_TOKENS), column).cast(T.StringType()).alias(name)
