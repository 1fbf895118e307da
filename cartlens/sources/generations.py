"""Tables published together, as generations: a reader sees one state of all tables or another, never a mixture.

A generation is a manifest: for every table its partitions, each with its number of rows, a fingerprint of its
content and the folder that holds it. Folders are never written twice. What did not change is carried over by naming
the former folder, so a new generation costs what changed. The manifest becomes current by one rename at the very
end; a run that is killed before leaves nothing but folders that no manifest names, which `clear` removes.

Below the root: `<table>/generation=<run>/[<column>=<value>/]` holds rows, `_generations/` one file per published
generation, which names the manifest's folder beside it. The rename needs a file system that renames at once (HDFS,
local); readers that hold an older generation keep reading it until it is cleared.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.columns import named

GENERATIONS = "_generations"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
FINGERPRINT = "table_name string, part string, row_count long, content string"
MANIFEST = FINGERPRINT + ", folder string, table_schema string"


class Files:
    """The few calls to the file system that Spark's readers and writers do not make."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(path)]

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def appear(self, path: str, text: str) -> None:
        """Write a small file elsewhere and rename it: `path` is there whole or not at all."""
        hidden = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(hidden), False)
        stream.write(text.encode())
        stream.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(self._path(hidden), self._path(path)):
            self.remove(hidden)
            raise RuntimeError(f"{path} was published by another run meanwhile")


def published(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all generations below `root`, ascending; the last one is current."""
    return sorted(int(name) for name in Files(spark, root).names(f"{root.rstrip('/')}/{GENERATIONS}") if name.isdigit())


def manifest(spark: SparkSession, root: str, generation: int | None = None) -> DataFrame:
    """MANIFEST rows of a generation, of the current one by default; none where nothing was published yet."""
    numbers = published(spark, root)
    if not numbers:
        return spark.createDataFrame([], MANIFEST)
    number = numbers[-1] if generation is None else generation
    if number not in numbers:
        raise ValueError(f"{root} has no generation {number}")
    folder = f"{root.rstrip('/')}/{GENERATIONS}"
    return spark.read.schema(MANIFEST).parquet(f"{folder}/{Files(spark, root).read(f'{folder}/{number}')}")


def publish(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """Make a manifest current; its number."""
    folder, run = f"{root.rstrip('/')}/{GENERATIONS}", f"manifest-{uuid.uuid4().hex}"
    number = (published(spark, root) or [0])[-1] + 1
    rows.write.parquet(f"{folder}/{run}")
    Files(spark, root).appear(f"{folder}/{number}", run)
    return number


def fingerprints(df: DataFrame, table: str, partition_by: str | None = None) -> DataFrame:
    """FINGERPRINT rows: for each partition its rows and two sums of row hashes, whatever the order of rows.

    One map-side fold; a change of any value, also one exchanged between two rows, changes both sums."""

    def total(seed: int) -> Column:
        row = F.xxhash64(F.lit(seed), *[F.struct(F.lit(i), named(name)) for i, name in enumerate(df.columns)])
        return F.sum(row.cast("decimal(20,0)")).cast("string")

    part = (named(partition_by) if partition_by else F.lit(None)).cast("string")
    folded = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws("/", total(1), total(2)).alias("content"))
    return folded.select(F.lit(table).alias("table_name"), "part", "row_count", "content")


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """table_name, part and change (`added`, `rewritten`, `removed`) of the partitions that differ."""
    old = before.select("table_name", "part", F.col("content").alias("old"), F.col("row_count").alias("old_rows"), F.lit(True).alias("was"))
    new = after.select("table_name", "part", "content", "row_count", F.lit(True).alias("is"))
    same = (old["table_name"] == new["table_name"]) & old["part"].eqNullSafe(new["part"])
    both = old.join(new, same, "full_outer").select(
        F.coalesce(new["table_name"], old["table_name"]).alias("table_name"), F.coalesce(new["part"], old["part"]).alias("part"),
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when((F.col("content") != F.col("old")) | (F.col("row_count") != F.col("old_rows")), "rewritten").alias("change"),
    )
    return both.where(F.col("change").isNotNull())


def write_parts(df: DataFrame, root: str, table: str, partition_by: str | None = None) -> dict[str | None, str]:
    """Write rows to a folder of their own; the folder of each partition."""
    folder = f"{root.rstrip('/')}/{table}/generation={uuid.uuid4().hex}"
    if partition_by is None:
        df.write.parquet(folder)
        return {None: folder}
    df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(folder)
    names = [name for name in Files(df.sparkSession, root).names(folder) if "=" in name]
    values = {name: unquote(name.partition("=")[2]) for name in names}
    return {None if value == NO_VALUE else value: f"{folder}/{name}" for name, value in values.items()}


def scan_parts(spark: SparkSession, root: str, table: str, rows: list) -> DataFrame:
    """A table from its manifest rows: one scan of the folders they name, partitions pruned as usual."""
    schema = T.StructType.fromJson(json.loads(rows[0]["table_schema"]))
    folders = [row["folder"] for row in rows if row["folder"]]
    if not folders:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema, T.StructField("generation", T.StringType())])
    reader = spark.read.schema(whole).option("basePath", f"{root.rstrip('/')}/{table}")
    return reader.parquet(*folders).select([named(name) for name in schema.names])


def clear(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Forget all but the newest `keep` generations and remove the folders that none of those names; how many.

    Not while another run writes below `root`: what it has written is not named yet."""
    files, home = Files(spark, root), f"{root.rstrip('/')}/{GENERATIONS}"
    numbers = published(spark, root)
    kept = numbers[-keep:]
    used = {row["folder"] for number in kept for row in manifest(spark, root, number).select("folder").distinct().collect()}
    manifests = {files.read(f"{home}/{number}") for number in kept}
    for number in numbers[: -keep or None]:
        files.remove(f"{home}/{number}")
    for name in files.names(home):
        if not name.isdigit() and name not in manifests:
            files.remove(f"{home}/{name}")
    removed = 0
    for table in [name for name in files.names(root) if not name.startswith("_")]:
        for run in [name for name in files.names(f"{root.rstrip('/')}/{table}") if name.startswith("generation=")]:
            folder = f"{root.rstrip('/')}/{table}/{run}"
            if folder in used:
                continue
            parts = [f"{folder}/{name}" for name in files.names(folder) if "=" in name]
            unused = [part for part in parts if part not in used]
            for gone in [folder] if len(unused) == len(parts) else unused:
                files.remove(gone)
                removed += 1
    return removed
