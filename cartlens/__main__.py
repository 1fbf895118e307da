"""Command line: build a warehouse, answer a report, write the exports.

    python -m cartlens build   <raw CSV folder> <warehouse> [--multi-line] [--catalog]
    python -m cartlens publish <raw CSV folder> <warehouse> [--multi-line] [--keep N]   bring up to date by what changed
    python -m cartlens profile <raw CSV folder>                row counts, types and nulls of the raw tables
    python -m cartlens show    <warehouse> <report> [--rows N]
    python -m cartlens write   <warehouse> <report> <folder>   the whole report as CSV
    python -m cartlens sql     <warehouse> <statement> [--rows N]
    python -m cartlens report  <warehouse> <folder>            workbook tables
    python -m cartlens star    <warehouse> <folder> [--verify] BI star schema
    python -m cartlens charts  <warehouse> <folder>            chart datasets
    python -m cartlens list
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cartlens.catalog import CATALOG, NEEDS_RAW, loaded_counts
from cartlens.operators.profile import profile_all
from cartlens.plans import charts, star, workbook
from cartlens.plans.publish import open_published, publish_warehouse
from cartlens.plans.spans import Spans, keep_spans
from cartlens.plans.warehouse import build_warehouse, open_warehouse, register_views, save_in_catalog
from cartlens.session import build_session
from cartlens.sources import generations
from cartlens.sources.csv import differing_csv, scan_all_csv, write_all_csv, write_csv
from cartlens.sources.stage import clear_stage

REPORTS = [name for name in CATALOG if name not in NEEDS_RAW]
ARGUMENTS = {
    "build": ["raw", "warehouse"], "publish": ["raw", "warehouse"], "profile": ["raw"], "show": ["warehouse", "report"],
    "write": ["warehouse", "report", "folder"], "sql": ["warehouse", "statement"], "report": ["warehouse", "folder"],
    "spans": ["warehouse", "figures"], "star": ["warehouse", "folder"], "charts": ["warehouse", "folder"], "list": [],
}

CHOICES = {"report": {"choices": REPORTS, "metavar": "report"}, "figures": {"choices": ["customers", "campaigns", "groups"]}}


def parsed(arguments: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(
        prog="cartlens", description=__doc__, formatter_class=argparse.RawTextHelpFormatter
    )
    actions = parser.add_subparsers(dest="action", required=True)
    for action, names in ARGUMENTS.items():
        sub = actions.add_parser(action)
        for name in names:
            sub.add_argument(name, **CHOICES.get(name, {}))
        if action in ("show", "sql"):
            sub.add_argument("--rows", type=int, default=100)
        if action in ("build", "publish", "profile"):
            sub.add_argument("--multi-line", action="store_true", help="line breaks inside quoted fields")
        if action == "publish":
            sub.add_argument("--keep", type=int, default=2, help="generations that stay readable")
            sub.add_argument("--spans", action="store_true", help="also keep event figures by day, for any span of days")
        if action == "spans":
            sub.add_argument("--first", help="first day, ISO text")
            sub.add_argument("--last", help="last day, ISO text")
        if action in ("report", "star", "charts"):
            sub.add_argument("--verify", action="store_true", help="read the files back and compare all rows")
        if action == "build":
            sub.add_argument("--catalog", action="store_true", help="also save the tables in the catalog")
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    given = parsed(arguments)
    if given.action == "list":
        print("\n".join(REPORTS))
        return
    spark = build_session()
    try:
        answer(spark, given)
    finally:
        clear_stage(spark)


def answer(spark: SparkSession, given: argparse.Namespace) -> None:
    if given.action == "profile":
        profile_all(scan_all_csv(spark, given.raw, given.multi_line)).show(1000, truncate=False)
        return
    if given.action == "build":
        built = build_warehouse(spark, given.raw, given.warehouse, multi_line=given.multi_line)
        if given.catalog:
            save_in_catalog(built)
        loaded_counts(built).show(truncate=False)
        return
    if given.action == "publish":
        more = keep_spans if given.spans else None
        publish_warehouse(spark, given.raw, given.warehouse, given.multi_line, more).show(1000, truncate=False)
        generations.clear(spark, given.warehouse, given.keep)
        return
    if given.action == "spans":
        getattr(Spans(spark, given.warehouse), given.figures)(given.first, given.last).show(1000, truncate=False)
        return
    opener = open_published if generations.published(spark, given.warehouse) else open_warehouse
    warehouse = opener(spark, given.warehouse)
    if given.action == "show":
        CATALOG[given.report](warehouse).show(given.rows, truncate=False)
    elif given.action == "sql":
        register_views(warehouse)
        spark.sql(given.statement).show(given.rows, truncate=False)
    elif given.action == "write":
        write_csv(CATALOG[given.report](warehouse), given.folder)
    else:
        if given.action == "report":
            tables = workbook.report_tables(warehouse)
        elif given.action == "star":
            tables = star.exports(warehouse)
        else:
            tables = {name: report(warehouse) for name, report in charts.REPORTS.items()}
        written = write_all_csv(tables, given.folder)
        if given.verify and (differing := differing_csv(tables, written).collect()):
            raise SystemExit("\n".join(f"{row.table_name}: {row.rows} rows, other than the {row.rows_in_files} in its files" for row in differing))
        for name, path in written.items():
            print(f"{name}: {path}")


if __name__ == "__main__":
    main()
