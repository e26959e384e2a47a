"""Reading bytes of a file inside a task, wherever the file lives."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def open_binary(path: str) -> BinaryIO:
    """A readable stream for a path as Spark reports it (local, HDFS or object store)."""
    if re.match(r"^(file:|/)", path):
        return open(unquote(urlparse(path).path), "rb")
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_stream(inner)


def create_binary(path: str) -> BinaryIO:
    """A writable stream, its folder made where the storage has folders."""
    if re.match(r"^(file:|/)", path):
        local = unquote(urlparse(path).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(inner)


def blocks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    with open_binary(path) as stream:
        while block := stream.read(size):
            yield block


def list_files(spark: SparkSession, path: str, pattern: str | None = None,
               files_per_task: int = 16) -> DataFrame:
    """(path) of the files under a folder, empty ones included; contents are not read.

    The names come from the file index that Spark holds for a scan, since a scan itself skips
    empty files. They are spread over tasks, each of which will open its files itself.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    names = [(name,) for name in reader.load(path).inputFiles()]
    tasks = max(1, -(-len(names) // files_per_task))
    return spark.createDataFrame(names, "path string").repartition(tasks)
