"""Session set-up and the shared folder in which jobs leave intermediate tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  **settings: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("furrow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors share one disk, may fall back to a fresh
    temporary folder, one per application.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="furrow-")
    return _local_folders[application]


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Functions that run in Python workers import it; Spark's own file server hands it out.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="furrow-package-"), "furrow.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, files in os.walk(root):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    target.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/furrow/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Used where several later jobs read the same shuffled result: the table is columnar, so each
    reader prunes to its own columns, its size is known to the optimizer, and the loss of an
    executor costs no recomputation. `partition_by` names a last column of few values; who asks for
    one of them reads its files only.
    """
    path = new_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table out of a few driver-known rows (one per column, class, file), built JVM-side."""
    names = [part.strip().split(" ")[0].split(":")[0] for part in _top_level(schema)]
    records = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(records), f"array<struct<{schema}>>")))


def _top_level(schema: str) -> list[str]:
    parts, depth = [""], 0
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return parts
