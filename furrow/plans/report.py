"""What a report says about a run, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(counts: DataFrame, quality: DataFrame, recs: DataFrame,
                scores: DataFrame | None = None) -> DataFrame:
    """(section, name, value): rows of each part, quality scores, applied rules, metrics.

    All inputs are small result tables: counts (part, rows), the quality report, the
    recommendations, and optionally (scheme, metric, value).
    """
    parts = [
        counts.select(F.lit("rows").alias("section"), F.col("part").alias("name"),
                      F.col("rows").cast("double").alias("value")),
        quality.select(F.lit("quality"), "dimension", F.col("score").cast("double")),
        recs.where("enabled").select(F.lit("applied_rule"), "id", F.lit(1.0)),
    ]
    if scores is not None:
        parts.append(scores.select(F.concat(F.lit("metric_"), F.col("scheme")), "metric", "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result
