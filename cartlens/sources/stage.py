"""Intermediate results written once as Parquet in the cluster's shared folder.

A staged table cuts lineage (a lost executor costs a re-read, not a recomputation), is column
pruned by whoever reads it, and carries file sizes, so that the planner broadcasts it only when it
is really small. All of an application's tables lie below one folder, which `clear_stage` removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and return a scan of what was written."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one uses its warehouse folder, which it
    names anyway; a cluster has to name a folder that every executor can reach."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
        folder = f"{spark.conf.get(WAREHOUSE_SETTING).rstrip('/')}/stage"
    return folder.rstrip("/")


def clear_stage(spark: SparkSession) -> None:
    """Remove everything this application has staged; tables read from it are gone afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
