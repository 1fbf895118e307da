"""The Spark session the command line, the bench and the tests run on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that decide results or plans, not cluster size: memory, executors and the number of
# shuffle partitions belong to whoever submits the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app_name: str = "cartlens", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the defaults above; `conf` uses `__` for dots, e.g. spark__ui__enabled="false"."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {key.replace("__", "."): str(value) for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
