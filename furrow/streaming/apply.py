"""Applying a saved state to a stream: the batch transformation is stateless, so it just runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from furrow.operators.fit import FittedState
from furrow.operators.transform import transform


def transform_stream(spark: SparkSession, source: str, schema, state: FittedState,
                     keep: Sequence[str] = (), files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder as a stream, transformed by a state fitted elsewhere; never refitted."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return transform(reader.parquet(source), state, keep=keep)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the checkpoint, exactly once, then stop."""
    return (
        df.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
