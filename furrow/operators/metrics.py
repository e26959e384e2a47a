"""Scores of predictions, by aggregation only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(scored: DataFrame) -> DataFrame:
    """(label, prediction, n): small whatever the table's size; combined before the shuffle."""
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(scored: DataFrame) -> DataFrame:
    """(metric, value) rows of accuracy, balanced accuracy and support-weighted F1.

    `scored` has `label` and `prediction`. Recall is averaged over classes that occur as labels;
    a class that neither occurs nor is predicted has an F1 of zero.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    by_class = confusion(scored).select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"))
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("predicted"))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    total = F.sum("support")
    return _rows(by_class.agg(
        (F.sum("hits") / total).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        (F.sum(f1 * F.col("support")) / total).alias("f1_weighted"),
    ))


def regression_metrics(scored: DataFrame) -> DataFrame:
    """(metric, value) rows of MAE, RMSE and R2 over double `label` and `prediction`; one pass."""
    error = F.col("label") - F.col("prediction")
    sums = scored.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("_mse"),
        F.var_pop("label").alias("_variance"),
    )
    r2 = F.when(F.col("_variance") > 0, 1 - F.col("_mse") / F.col("_variance")).when(
        F.col("_mse") == 0, 1.0).otherwise(0.0)
    return _rows(sums.select("mae", F.sqrt("_mse").alias("rmse"), r2.alias("r2")))


def _rows(wide: DataFrame) -> DataFrame:
    def row(name: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"))

    return wide.select(F.inline(F.array(*[row(c) for c in wide.columns])))
