"""Order-free sums of row digests, and written files held against what was to be written."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from cartlens import __main__ as main
from cartlens.operators.profile import row_sums, value_sums
from cartlens.plans import star
from cartlens.sources import csv
from cartlens.sources.csv import differing_csv, write_all_csv, write_csv


def sums(df, **options):
    return tuple(row_sums(df, "t", **options).first())[1:]


def rows(spark, *values):
    return spark.createDataFrame(list(values), "a string, b string")


def test_order_of_rows_and_columns_does_not_count(spark):
    df = rows(spark, ("1", "x"), ("2", "y"), ("2", "y"))
    assert sums(df) == sums(df.orderBy("a", ascending=False).repartition(3).select("b", "a"))


@pytest.mark.parametrize("other", [
    [("1", "y"), ("2", "x")], [("1", "x"), ("1", "x")], [("1", "x")], [("1", "x"), ("2", "z")],
    [("1x", ""), ("2", "y")], [("1", "x"), ("2", None)], [("x", "1"), ("y", "2")],
])
def test_any_other_rows_show(spark, other):
    assert sums(rows(spark, ("1", "x"), ("2", "y"))) != sums(rows(spark, *other))


def test_exchanged_values_show_where_sums_do_not(spark):
    one, two = rows(spark, ("1", "10"), ("2", "20")), rows(spark, ("1", "20"), ("2", "10"))
    by_column = [sorted(map(tuple, value_sums(df, "t").collect())) for df in (one, two)]
    assert by_column[0] == by_column[1] and sums(one) != sums(two) and sums(one, by_value=True) != sums(two, by_value=True)


def test_numbers_by_value(spark):
    one, two = rows(spark, ("1.50", "-0.0004")), rows(spark, ("1.5000", "0"))
    assert sums(one, by_value=True) == sums(two, by_value=True) and sums(one) != sums(two)


def test_no_rows(spark):
    assert sums(rows(spark).where("false")) == (0, "0", "0")


ODD = """SELECT * FROM VALUES
    ('a "quoted", text', 1.0D, CAST(2.50 AS DECIMAL(9,4)), timestamp_ntz'2024-01-02 00:00:00', date'2024-01-02', true),
    ('line\nbreak\r\n', 1e12D, null, timestamp_ntz'2024-01-02 03:04:05.000600', null, false),
    ('', -1e-7D, CAST(0 AS DECIMAL(9,4)), null, date'1999-12-31', null),
    (' spaces ', null, null, null, null, null), ('\\\\ \\\\"', 0.1D, null, null, null, true), (null, null, null, null, null, null)
    AS t(`some text`, d, m, at, day, flag)"""


def test_written_files_hold_the_rows(spark, tmp_path):
    frames = {"odd": spark.sql(ODD), "none": spark.sql(ODD).where("false")}
    paths = write_all_csv(frames, str(tmp_path))
    assert differing_csv(frames, paths).collect() == []


def test_two_swapped_values_are_found(spark, tmp_path):
    good = spark.sql("SELECT id, id * 3 AS v, 'x' AS c FROM range(1000)")
    paths = write_all_csv({"good": good, "bad": good}, str(tmp_path))
    write_csv(good.selectExpr("id", "CASE id WHEN 7 THEN 24 WHEN 8 THEN 21 ELSE v END AS v", "c"), paths["bad"])
    assert [tuple(row) for row in differing_csv({"good": good, "bad": good}, paths).collect()] == [("bad", 1000, 1000)]
    write_csv(good.where("id > 0"), paths["bad"])
    assert [tuple(row) for row in differing_csv({"good": good, "bad": good}, paths).collect()] == [("bad", 1000, 999)]


def test_verified_export(spark, tmp_path, small_warehouse, monkeypatch, capsys):
    monkeypatch.setattr(main, "open_warehouse", lambda *_: small_warehouse)
    given = main.parsed(["star", str(tmp_path / "none"), str(tmp_path / "out"), "--verify"])
    main.answer(spark, given)
    assert len(capsys.readouterr().out.splitlines()) == len(star.EXPORTS)
    monkeypatch.setattr(main, "write_all_csv", lambda tables, folder: write_all_csv(
        {name: df.limit(1) if name == "dim_products" else df for name, df in tables.items()}, folder))
    with pytest.raises(SystemExit, match="^dim_products: [0-9]+ rows, other than the 1 in its files$"):
        main.answer(spark, given)


NUMBERS = ["1", "-1", "+1", " 12 ", "1.50", ".5", "5.", "1e3", "1E+3", "-.5e-2", "\t7\n", "٣٤", "-0", "007", "1" * 32]
NO_NUMBERS = ["-", ".", " ", "1996-03-13", "1-2-3", "1.2.3", "1e", "1d", "NaN", "true", "1 2", "1" * 33, "1e400", "7\x7f"]


def test_only_texts_like_numbers_are_cast(spark):
    """What is no number costs an error that is raised and caught; the sums are those of casting every text."""
    df = spark.createDataFrame([(text,) for text in [*NUMBERS, *NO_NUMBERS, None]], "t string")
    number = F.col("t").try_cast("decimal(38,6)")
    cast = df.agg(F.round(F.sum(number), 3).cast("double"), F.sum(F.when(number.isNull(), F.length("t")))).first()
    row = value_sums(df, "t").first()
    assert (row.total, row.letters) == tuple(cast) and df.where(number.isNull()).count() == len(NO_NUMBERS) + 1
    for summed in (value_sums(df, "t"), row_sums(df, "t", by_value=True)):
        plan = summed._jdf.queryExecution().optimizedPlan().toString()
        casts = len(re.findall(r"try_cast\(.{1,40}? as decimal\(38,6\)\)", plan))
        assert plan.count("RLIKE") == casts > 0


def test_decimals_lose_zeros_without_a_number_format(spark):
    values = ["0", "-0.1", "100", "100.5", "-100", "0.000001", "-0.000001", "1234567.89", "10", None]
    texts = spark.createDataFrame([(v,) for v in values], "v string")
    kinds = ["decimal(10,1)", "decimal(18,4)", "decimal(18,6)", "decimal(38,6)"]
    df = texts.select(*[F.col("v").cast(kind).alias(kind) for kind in kinds])
    plain = csv._rendered(df)
    assert "format_number" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert plain.collect() == df.select(*[csv._plain_number(kind) for kind in kinds]).collect()


def test_frames_are_written_side_by_side(spark, tmp_path, monkeypatch):
    both = threading.Barrier(2)
    monkeypatch.setattr(csv, "write_csv", lambda df, path: both.wait(timeout=20))
    assert list(write_all_csv({"a": spark.range(1), "b": spark.range(1)}, str(tmp_path))) == ["a", "b"]
