"""Timings as one JSON line: the full warehouse build, then the standing reports on it.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the threads.
Every query runs once, whole, into Spark's no-op sink; marts built from scratch are timed apart from
reports that read the stored marts.
"""

from __future__ import annotations

import json
import os
import time

from cartlens.catalog import CATALOG
from cartlens.plans import marts
from cartlens.plans.warehouse import build_warehouse
from cartlens.session import build_session
from cartlens.sources.stage import clear_stage, new_folder
from cartlens.sources.testdata import raw_tables

MARTS = {
    "customer_360": lambda w: marts.customer_360(w.customers, w.transactions, w.events),
    "campaign_performance": lambda w: marts.campaign_performance(w.campaigns, w.transactions, w.events),
    "product_performance": lambda w: marts.product_performance(w.products, w.transactions),
    "funnel": lambda w: marts.funnel(w.events),
}
REPORTS = [name for name in CATALOG if name.startswith("q")] + [
    "eda_null_pct", "cust_signup_pivot", "ab_chi2", "activity_heatmap", "session_duration_by_page", "xl_kpis",
    "xl_channel_rev", "xl_data_sheets", "fact_transactions", "dim_date",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()

    seconds: dict[str, float] = {}

    def timed(name: str, work) -> object:
        started = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - started, 3)
        return result

    root = new_folder(spark, "bench-warehouse")
    warehouse = timed("build_warehouse", lambda: build_warehouse(spark, raw_tables(spark, sf_dir), root))
    for name, build in MARTS.items():
        timed(f"mart_{name}", lambda: run(build(warehouse)))
    for name in REPORTS:
        timed(name, lambda: run(CATALOG[name](warehouse)))

    clear_stage(spark)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "warehouse build and reports",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
