"""CSV rules, sinks read back, stage tables, the full build."""

import os
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cartlens import __main__ as main
from cartlens.plans import star, workbook
from cartlens.plans.warehouse import MARTS, build_warehouse, open_warehouse, side_by_side
from cartlens.sources import csv, stage, tables
from cartlens.sources.schemas import RAW_COLUMNS
from cartlens.sources.testdata import raw_tables
from tests.conftest import SMALL
from tests.test_clean import DEFAULTS


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_missing_values_and_column_order(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'age,extra,country,customer_id\nNA,x,"a, ""b""",1\n,y,null,2\n30,z, None ,3\n')
    rows = csv.scan_csv(spark, path, ["customer_id", "age", "country"]).collect()
    assert [tuple(r) for r in rows] == [("1", None, 'a, "b"'), ("2", None, None), ("3", "30", " None ")]


def test_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column c"):
        csv.scan_csv(spark, path, ["a", "c"])


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "c.csv", 'a,b\n"x\ny",2\n')
    assert csv.scan_csv(spark, path, ["a", "b"], multi_line=True).first().a == "x\ny"


@pytest.mark.parametrize("text, bad", [
    ('a,b\n"x\ny",2\n3,4\n', True), ("a,b\n1,2,3\n4,5\n", True), ("a,b\n1\n4,5\n", True), ("a,b\n1,2\n", False)])
def test_malformed_rows_are_errors(spark, tmp_path, text, bad):
    """A break in quotes, a field too many, a field too few: found, counted, never read in silence."""
    path = write(tmp_path / "c.csv", text)
    assert (csv.malformed_rows(spark, path).count() > 0) == bad
    for columns in (["a", "b"], ["a"]):
        frame = csv.scan_csv(spark, path, columns)
        if bad:
            with pytest.raises(Exception, match="malformed row"):
                frame.collect()
        else:
            assert frame.count() == 1


def raw_folder(spark, folder, **rows):
    """Five small CSV files; what is not given is one row of defaults."""
    for name, columns in RAW_COLUMNS.items():
        lines = [",".join(columns)]
        for row in rows.get(name, [{}]):
            lines.append(",".join("" if (v := (DEFAULTS[name] | row)[c]) is None else str(v) for c in columns))
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def test_build_takes_line_breaks_and_refuses_broken_rows(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    raw = raw_folder(spark, tmp_path / "raw", products=[dict(brand='"A\nB"')])
    with pytest.raises(Exception, match="malformed row"):
        build_warehouse(spark, raw, str(tmp_path / "broken"))
    built = build_warehouse(spark, raw, str(tmp_path / "warehouse"), multi_line=True)
    assert [row.brand for row in built.products.collect()] == ["A\nB"]


def test_data_sheet_takes_ids_by_number(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    ids = [dict(transaction_id=i) for i in range(20, 0, -1)]
    raw = raw_folder(spark, tmp_path / "raw", transactions=ids)
    built = build_warehouse(spark, raw, str(tmp_path / "warehouse"))
    assert [r.transaction_id for r in workbook.data_transactions(built, 7).collect()] == [str(i) for i in range(1, 8)]
    assert workbook.data_transactions(built).count() == 20


def test_commands(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "raw").mkdir()
    raw = raw_folder(spark, tmp_path / "raw", transactions=[dict(transaction_id=i) for i in range(5)])
    warehouse, out = str(tmp_path / "warehouse"), str(tmp_path / "out")
    cleared = []
    monkeypatch.setattr(main, "build_session", lambda: spark)
    monkeypatch.setattr(main, "clear_stage", cleared.append)

    def said(*arguments):
        main.main(list(arguments))
        return capsys.readouterr().out

    assert "mart_funnel" in said("build", raw, warehouse)
    assert "expected_uplift" in said("profile", raw)
    listed = said("list").split()
    assert "q01_monthly_revenue" in listed and "scan_csv" not in listed
    said("write", warehouse, "clean_transactions", out)
    assert spark.read.option("header", True).csv(out).count() == 5
    assert "only showing top 2 rows" in said("show", warehouse, "clean_transactions", "--rows", "2")
    # Statements over the views: a total, a join with a mart, a ranking by window.
    assert "|5 " in said("sql", warehouse, "SELECT count(*) AS n FROM transactions")
    joined = "SELECT c.country, m.total_orders FROM customers c JOIN mart_customer_360 m USING (customer_id)"
    assert "total_orders" in said("sql", warehouse, joined)
    ranked = "SELECT stage, rank() OVER (ORDER BY count DESC) AS place FROM mart_funnel"
    assert "add_to_cart" in said("sql", warehouse, ranked)
    with pytest.raises(SystemExit):
        main.main(["show", warehouse, "scan_csv"])
    versions = str(tmp_path / "versions")
    assert "transactions" in said("publish", raw, versions)
    assert "transactions" not in said("publish", raw, versions)
    assert "only showing top 2 rows" in said("show", versions, "clean_transactions", "--rows", "2")
    assert len(cleared) == 10


def test_nothing_staged_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "shared_folder", lambda _: str(tmp_path))
    assert stage.stage(spark.range(3), "left-over").count() == 3
    assert os.listdir(tmp_path) == [spark.sparkContext.applicationId]
    stage.clear_stage(spark)
    assert os.listdir(tmp_path) == []


def test_csv_round_trip_keeps_text(spark, tmp_path):
    frame = spark.createDataFrame([(1, ' a "q", b '), (2, None)], "i int, t string")
    csv.write_csv(frame, str(tmp_path / "out"))
    rows = csv.scan_csv(spark, str(tmp_path / "out"), ["i", "t"]).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [("1", ' a "q", b '), ("2", None)]


def test_numbers_are_written_plainly(spark, tmp_path):
    frame = spark.sql("SELECT 12345678.9D AS a, CAST(5 AS DOUBLE) AS b, CAST(1.5 AS DECIMAL(18,4)) AS c, "
                      "CAST(NULL AS DOUBLE) AS d, -0.00012D AS e, 7 AS f")
    csv.write_csv(frame, str(tmp_path / "out"))
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert tuple(row) == ("12345678.9", "5", "1.5", None, "-0.00012", "7")


def test_partitioned_table(spark, tmp_path):
    frame = spark.range(100).select("id", F.concat(F.lit("2024-0"), F.col("id") % 3 + 1).alias("month"))
    path = tables.write_table(frame, str(tmp_path), "t", "month")
    assert sorted(name for name in os.listdir(path) if name.startswith("month=")) == [
        "month=2024-01", "month=2024-02", "month=2024-03"]
    back = tables.scan_table(spark, str(tmp_path), "t")
    assert sorted(tuple(r) for r in back.select("id", "month").collect()) == sorted(
        tuple(r) for r in frame.collect())
    assert "PartitionFilters: [isnotnull(month" in back.where("month = '2024-01'")._jdf.queryExecution().toString()


def test_tables_are_replaced(spark, tmp_path):
    for rows in (5, 2):
        tables.write_mart(spark.range(rows), str(tmp_path), "m")
    assert tables.scan_table(spark, str(tmp_path), "mart_m").count() == 2


def test_catalog_table(spark):
    spark.sql("DROP TABLE IF EXISTS cartlens_test_table")
    try:
        for rows in (5, 2):
            saved = tables.save_as_catalog_table(spark.range(rows).withColumn("p", F.lit("x")), "cartlens_test_table",
                                                 "p")
        assert saved.count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS cartlens_test_table")


def test_stage_is_a_scan_of_written_rows(spark):
    staged = stage.stage(spark.range(10).withColumn("r", F.rand()), "test")
    assert staged.orderBy("id").collect() == staged.orderBy("id").collect()
    assert "FileScan parquet" in staged._jdf.queryExecution().toString()


class Context:
    applicationId = "app-1"

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder


def session(master, setting=None, folder=None):
    def get(key, default=None):
        return "/where/tables/are" if key == stage.WAREHOUSE_SETTING else setting or default

    conf = SimpleNamespace(get=get)
    return SimpleNamespace(conf=conf, sparkContext=Context(master, folder))


def test_stage_folder_comes_from_the_session():
    assert stage.new_folder(session("yarn", "hdfs://n/shared/"), "x").startswith("hdfs://n/shared/app-1/x-")
    assert stage.shared_folder(session("yarn", None, "hdfs://n/set/by/code")) == "hdfs://n/set/by/code"


def test_only_a_local_session_gets_a_folder_of_its_own():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.shared_folder(session("spark://host:7077"))
    assert stage.shared_folder(session("local[2]")) == "/where/tables/are/stage"


def test_full_build_from_csv_equals_the_build_from_frames(spark, tmp_path, small_warehouse):
    """Raw tables go out as CSV text and come back through scan, cleaning and marts."""
    raw = raw_tables(spark, SMALL)
    for name, frame in raw.items():
        csv.write_csv(frame.select(RAW_COLUMNS[name]), str(tmp_path / "raw" / f"{name}.csv"))
    built = build_warehouse(spark, str(tmp_path / "raw"), str(tmp_path / "warehouse"))
    reopened = open_warehouse(spark, str(tmp_path / "warehouse"))
    for name in ["customers", "transactions", *MARTS]:
        expected, found = getattr(small_warehouse, name), getattr(reopened, name)
        assert sorted(found.columns) == sorted(expected.columns)
        columns = [c for c in expected.columns if c not in ("session_id", "event_id")]
        assert found.select(columns).exceptAll(expected.select(columns)).count() == 0, name
        assert expected.select(columns).exceptAll(found.select(columns)).count() == 0, name
    assert built.events.count() == small_warehouse.events.count()


def test_star_export_reads_back(spark, tmp_path, small_warehouse):
    paths = csv.write_all_csv(star.exports(small_warehouse), str(tmp_path))
    assert len(paths) == 9
    fact = spark.read.option("header", True).csv(paths["fact_transactions"])
    assert fact.count() == small_warehouse.transactions.count()
    total = fact.agg(F.sum(F.col("net_revenue").cast("decimal(18,4)"))).first()[0]
    assert total == small_warehouse.transactions.agg(F.sum("net_revenue")).first()[0]
    assert isinstance(total, Decimal)


def test_report_tables_have_sheet_headers(spark, tmp_path, small_warehouse):
    paths = workbook.write_report_tables(small_warehouse, str(tmp_path))
    assert set(paths) == set(workbook.SECTIONS)
    months = spark.read.option("header", True).csv(paths["revenue_trends"])
    assert months.columns == ["Month", "Orders", "Gross Revenue", "Net Revenue", "Avg Order Value", "Refunds"]


def test_side_by_side_raises():
    def fail():
        raise KeyError("x")

    with pytest.raises(KeyError):
        side_by_side([lambda: 1, fail])
    assert side_by_side([lambda: 1, lambda: 2]) == [1, 2]
