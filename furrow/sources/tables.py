"""Parquet working tables, JSON records, and fingerprints of files and tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import whole_row_token
from furrow.sources.storage import blocks, list_files


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A working table; that it is missing is said as such."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise M.PreparationError(f"working table is missing: {path}") from e
        raise


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_sha256(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size, sha256) of every file; tasks stream their files in 1 MiB blocks."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["path"]:
                total, size = hashlib.sha256(), 0
                for block in blocks(file):
                    total.update(block)
                    size += len(block)
                rows.append((file, size, total.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    return list_files(spark, path, pattern, files_per_task=1).mapInPandas(
        digest, "path string, size bigint, sha256 string")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): independent of row order and partitioning, for a table of any size.

    The sums of both halves of a 128-bit digest per row, apart by a dash; one aggregate without a
    data shuffle. The digest is over exact values, each preceded by its length: no separator inside a
    text and no rounding makes two rows equal, and a repeated row counts each time.
    """
    halves = [F.conv(F.substring("_digest", start, 16), 16, 10).cast("decimal(38,0)")
              for start in (1, 17)]
    sums = [F.coalesce(F.sum(half), F.lit(0)).cast("decimal(38,0)").cast("string")
            for half in halves]
    return df.select(whole_row_token(df.schema, df.columns).alias("_digest")).agg(
        F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *sums).alias("fingerprint"))
