"""Target encoding in which no row sees its own target.

Training rows are dealt into folds by a hash of their key. A category's value for the rows of a fold
is the mean target of that category over the other folds, drawn towards the mean of all rows
outside the fold. Rows that were not trained on get the values of the whole training part.

All columns are counted by one aggregation over (column, category, fold), which combines a frequent
category inside every task before anything is shuffled. The rows then look their values up by
(category, fold); a table of few categories is broadcast by its stored size, otherwise a frequent
category's rows are at least spread over the folds and split by the session's skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import keyed_token, normalize_category, quoted, strict_double
from furrow.session import materialize

FOLDS, SMOOTHING, SEED = 5, 10.0, 42
# The fold number of rows that were not trained on.
OUTSIDE = -1
SUFFIX = "__target"


@dataclass
class TargetEncoding:
    """What was learned: a table with a row per (column, category, fold), and means per fold.

    `sums` holds count and target sum of the rows outside the fold; fold -1 is outside of none.
    """

    sums: DataFrame
    priors: dict[int, float | None]
    columns: list[str]
    key: list[str]
    folds: int
    seed: int
    smoothing: float

    def fold(self) -> Column:
        return fold_of(self.key, self.folds, self.seed)


def fold_of(key: Sequence[str], folds: int, seed: int) -> Column:
    """A row's fold, from its key; copies of a row are in one fold."""
    token = keyed_token([F.lit("fold"), *[quoted(c) for c in key]], seed)
    return (F.conv(F.substring(token, 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def category(column: str) -> Column:
    """A column's value as a category; missing values are one of their own."""
    return F.coalesce(normalize_category(quoted(column)), F.lit(M.MISSING_LABEL))


def target_value(train: DataFrame, target: str, positive: str | None) -> Column:
    """The target as a number: itself, or 1 for rows of the class `positive` and 0 for others."""
    if positive is None:
        return strict_double(quoted(target), train.schema[target].dataType)
    return F.when(quoted(target).isNotNull(),
                  (quoted(target).cast("string") == positive).cast("double"))


def fit_target_encoding(train: DataFrame, columns: Sequence[str], target: str,
                        key: Sequence[str] | None = None, positive: str | None = None,
                        folds: int = FOLDS, smoothing: float = SMOOTHING,
                        seed: int = SEED) -> TargetEncoding:
    """Learn the encoding of `columns` from training rows that have a target.

    `key` names the columns that identify a row, all of them if none are given; `positive` the class
    whose share is the value, for a target that is no number.
    """
    if folds < 2:
        raise M.PreparationError("target encoding needs two folds or more")
    if smoothing < 0:
        raise M.PreparationError("smoothing cannot be negative")
    if target in columns:
        raise M.PreparationError("the target cannot be encoded by itself")
    key = list(key or [c for c in train.columns if c != target])
    rows = train.select(
        fold_of(key, folds, seed).alias("fold"), target_value(train, target, positive).alias("y"),
        F.array(*[F.struct(F.lit(i).alias("column"), category(c).alias("value"))
                  for i, c in enumerate(columns)]).alias("cells")).where("y IS NOT NULL")
    own = materialize(
        rows.select("fold", "y", F.inline("cells")).groupBy("column", "value", "fold").agg(
            F.count("*").alias("n"), F.sum("y").alias("total")), "target-folds")
    # The other folds are added up anew: taking a fold's sum off the total would leave a trace of
    # its targets in the rounding, and all of it if one of them is very large.
    by_fold = own.groupBy("column", "value").agg(
        F.array_sort(F.collect_list(F.struct("fold", "n", "total"))).alias("per_fold"))

    def others(name: str, zero: Column) -> Column:
        return F.aggregate("per_fold", zero, lambda done, x: F.when(
            x["fold"] != F.col("fold"), done + x[name]).otherwise(done)).alias(name)

    sums = by_fold.withColumn("fold", F.explode(F.sequence(F.lit(OUTSIDE), F.lit(folds - 1)))).select(
        "column", "value", "fold", others("n", F.lit(0).cast("long")), others("total", F.lit(0.0)))
    # One row per fold.
    per_fold = sorted((r["fold"], r["n"], r["total"]) for r in own.where("column = 0").groupBy(
        "fold").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    priors = {}
    for fold in range(OUTSIDE, folds):
        n = sum(own_n for f, own_n, _ in per_fold if f != fold)
        total = sum(own_total for f, _, own_total in per_fold if f != fold)
        priors[fold] = total / n if n else None
    return TargetEncoding(materialize(sums, "target-sums"), priors, list(columns), key, folds,
                          seed, smoothing)


def _encoded(df: DataFrame, encoding: TargetEncoding, fold: Column) -> DataFrame:
    names = [c + SUFFIX for c in encoding.columns]
    if clash := set(names) & set(df.columns):
        raise M.PreparationError(f"output columns exist already: {sorted(clash)}")
    rows = df.withColumn("_fold", fold)
    prior = F.element_at(F.array(*[
        F.lit(encoding.priors[k]).cast("double") for k in range(OUTSIDE, encoding.folds)]),
        F.col("_fold") - OUTSIDE + 1)
    for i, column in enumerate(encoding.columns):
        known = encoding.sums.where(F.col("column") == i).select(
            F.col("value").alias("_value"), F.col("fold").alias("_of"),
            F.col("n").alias("_n"), F.col("total").alias("_total"))
        m = F.lit(encoding.smoothing)
        n = F.coalesce("_n", F.lit(0))
        # Without a row to learn from there is only the mean of all others.
        value = F.when(n + m > 0, F.try_divide(
            F.when(n > 0, F.col("_total")).otherwise(F.lit(0.0)) + m * prior, n + m)).otherwise(prior)
        rows = rows.join(known, (category(column) == F.col("_value"))
                         & (F.col("_fold") == F.col("_of")), "left").withColumn(
            names[i], value).drop("_value", "_of", "_n", "_total")
    return rows.drop("_fold")


def encode_training(train: DataFrame, encoding: TargetEncoding) -> DataFrame:
    """The training rows with a `__target` column per encoded one, learned from the other folds.

    A row without a target gets values as well. Where all rows lie in one fold there is nothing to
    learn from, and the value is null.
    """
    return _encoded(train, encoding, encoding.fold())


def encode_others(df: DataFrame, encoding: TargetEncoding) -> DataFrame:
    """Rows that were not trained on, by the whole training part; new categories get its mean."""
    return _encoded(df, encoding, F.lit(OUTSIDE))
