"""The profile of a stream: every micro-batch leaves one mergeable row per column.

Counts add up, ranges widen and distinct sketches unite, so the profile at any moment is a merge of
the stored rows and no state grows with the stream, but for the ids of events inside the watermark.
A batch that is run again after a loss overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from furrow import model as M
from furrow.functions.text import exact_text, finite_double, quoted

# Sketches of 2^12 registers: a standard error of about 1.6 %.
SKETCH_BITS = 12


def _measure(value: Column, dtype: T.DataType) -> Column:
    """What a range is taken of: numbers, and seconds since 1970 of times; text has none."""
    if isinstance(dtype, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")) / 1e6
    if isinstance(dtype, T.NumericType):
        return finite_double(value, dtype)
    return F.lit(None).cast("double")


def profile_parts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, present, low, high, sketch), one row per column, from one pass without a shuffle
    of rows. Without rows, counts are 0 and ranges null."""
    lost = [c for c in columns if c not in df.columns]
    if lost or not columns:
        raise M.PreparationError("no such column: " + ", ".join(lost))
    types = {f.name: f.dataType for f in df.schema}

    def facts(name: str) -> Column:
        value, size = quoted(name), _measure(quoted(name), types[name])
        text = F.when(value.isNotNull(), exact_text(value, types[name]))
        return F.struct(F.lit(name).alias("column"), F.count(F.lit(1)).alias("rows"),
                        F.count(value).alias("present"), F.min(size).alias("low"),
                        F.max(size).alias("high"), F.hll_sketch_agg(text, SKETCH_BITS).alias("sketch"))

    return df.agg(F.array(*map(facts, columns)).alias("facts")).select(F.inline("facts"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """(column, rows, missing, low, high, about_distinct) of rows from any number of batches."""
    sums = parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("present")).alias("missing"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("sketch").alias("_sketch"))
    return sums.select("column", "rows", "missing", "low", "high",
                       F.hll_sketch_estimate("_sketch").alias("about_distinct"))


def profile_stream(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str,
                   event_id: str, event_time: str, delay: str) -> StreamingQuery:
    """Profile what has arrived since the checkpoint, then stop.

    An event counts once: a repeated id within `delay` of its first event time is left out, and so is
    a row older than the latest time seen in earlier batches less `delay`. Rows without a time do not
    move the watermark and count as late once there is one. A time without a zone is one of the
    session's.
    """
    def store(batch: DataFrame, number: int) -> None:
        profile_parts(batch, columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(event_time, quoted(event_time).cast("timestamp"))
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([event_id])
    return once.writeStream.foreachBatch(store).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_profile(spark: SparkSession, path: str) -> DataFrame:
    """The profile of all batches stored so far."""
    return merge_parts(spark.read.parquet(path))
