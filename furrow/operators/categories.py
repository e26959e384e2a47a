"""Categories: near-constant columns, rare values, class balance, encodings, and resampling of classes.

All of it rests on grouped counts of values, which are combined in every task before the shuffle, so
a value that holds most rows costs no more than another. What is learned comes from training rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import keyed_token, normalize_category, quoted
from furrow.operators.fit import category_counts
from furrow.operators.split import CLASS, SPLIT, TEST, TOKEN, class_counts, mark_rows
from furrow.session import materialize

# ---- fixed values: the limits of the specification ----
NEAR_CONSTANT = 0.99
RARE_SHARE, RARE_ROWS = 0.01, 20
IMBALANCED, SEVERE = 0.2, 0.1
OTHER_LABEL = "__OTHER__"
# -------------------------------------------------------
COPY = "copy"


# ---- columns and values -------------------------------------------------------------------------

def near_constant(df: DataFrame, columns: Sequence[str], share: float = NEAR_CONSTANT) -> DataFrame:
    """(column, value, n, rows, share) of columns whose most frequent value holds `share` of all rows.

    Values are compared as trimmed text; null is a value like others. An empty table has no columns.
    """
    if not 0.5 < share <= 1:
        raise M.PreparationError("the share lies above 0.5 and is 1 at most")
    top = category_counts(df, columns).groupBy("column").agg(
        F.max(F.struct("n", "value")).alias("top"), F.sum("n").alias("rows"))
    found = top.select("column", "top.value", "top.n", "rows",
                       (F.col("top.n") / F.col("rows")).alias("share"))
    return found.where(F.col("share") >= share)


def _present_counts(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    counts = materialize(category_counts(df, columns).where("value IS NOT NULL"), "values")
    return counts, counts.groupBy("column").agg(F.sum("n").alias("present"))


def _is_rare(share: float, rows: int) -> Column:
    return (F.col("n") < rows) | (F.col("n") / F.col("present") < share)


def rare_categories(df: DataFrame, columns: Sequence[str], share: float = RARE_SHARE,
                    rows: int = RARE_ROWS) -> DataFrame:
    """(column, value, n, share) of values in fewer than `rows` rows, or less than `share` of those
    that have a value."""
    counts, present = _present_counts(df, columns)
    return counts.join(F.broadcast(present), "column").where(_is_rare(share, rows)).select(
        "column", "value", "n", (F.col("n") / F.col("present")).alias("share"))


@dataclass
class CommonValues:
    """Per column the values that are not rare in training, sorted: at most 1 / share of them."""

    values: dict[str, list[str]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CommonValues:
        return cls(**json.loads(text))


def fit_common(train: DataFrame, columns: Sequence[str], share: float = RARE_SHARE,
               rows: int = RARE_ROWS) -> CommonValues:
    """The values to keep. A share above 0 bounds what reaches the driver."""
    if not 0 < share < 1:
        raise M.PreparationError("the share of a rare value lies between 0 and 1")
    counts, present = _present_counts(train, columns)
    kept = counts.join(F.broadcast(present), "column").where(~_is_rare(share, rows)).collect()
    return CommonValues({c: sorted(r["value"] for r in kept if r["column"] == c) for c in columns})


def merge_rare(df: DataFrame, state: CommonValues, label: str = OTHER_LABEL) -> DataFrame:
    """The rows with every rare or new value put as `label`; null stays null. A projection."""
    def merged(name: str) -> Column:
        value = normalize_category(quoted(name))
        kept = value.isin(state.values[name]) if state.values[name] else F.lit(False)
        return F.when(kept, value).when(value.isNotNull(), F.lit(label)).alias(name)

    return df.select(*[merged(c) if c in state.values else quoted(c) for c in df.columns])


# ---- classes ------------------------------------------------------------------------------------

def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, share, weight): weights that make all classes weigh alike and sum to the rows.

    Rows without a target have no class.
    """
    counts = materialize(df.where(quoted(target).isNotNull()).groupBy(
        quoted(target).alias("class")).agg(F.count(F.lit(1)).alias("n")), "classes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                       F.count(F.lit(1)).alias("classes")).head()
    return counts.select(
        "class", "n", (F.col("n") / F.lit(total["rows"])).alias("share"),
        (F.lit(total["rows"]) / (F.lit(total["classes"]) * F.col("n"))).alias("weight"))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, classes, least_share (null without rows) and its level."""
    weights = class_weights(df, target)
    least = F.min("share")
    return weights.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("classes"),
        least.alias("least_share"),
        F.when(least < SEVERE, "severe").when(least < IMBALANCED, "imbalanced")
        .when(least.isNotNull(), "balanced").alias("level"))


def resample(train: DataFrame, target: str, key: Sequence[str], rows_per_class: str = "most",
             seed: int = 42) -> DataFrame:
    """Training rows with equally large classes, and a column `copy` that counts from 0.

    "most" repeats rows until every class is as large as the largest, "least" draws as many of each
    class as the smallest has. Repeats are whole rounds of a class, and then rows drawn by a hash of
    the key and seed; a class is never sorted: the cut of its draw is found by counting hashes. Rows
    without a target are left out. Rows that share a key are drawn by all of their columns.
    """
    if rows_per_class not in ("most", "least"):
        raise M.PreparationError("classes are made as large as the most or the least frequent one")
    for name in (COPY, SPLIT):
        if name in (c.lower() for c in train.columns):
            raise M.PreparationError(f"a column is named {name} already")
    eligible = train.where(quoted(target).isNotNull())
    classes = materialize(class_counts(eligible, target), "classes")
    ends = classes.agg(F.min("rows").alias("least"), F.max("rows").alias("most"),
                       F.sum("rows").alias("n")).head()
    if ends["n"] is None:
        return eligible.withColumn(COPY, F.lit(0).cast("bigint"))
    wanted = F.lit(ends[rows_per_class])
    quotas = materialize(classes.select(
        CLASS, F.floor(wanted / F.col("rows")).cast("bigint").alias("rounds"),
        (wanted % F.col("rows")).cast("bigint").alias("need")), "quotas")
    hashed = eligible.withColumn(CLASS, quoted(target)).withColumn(
        TOKEN, keyed_token([quoted(c) for c in key], seed))
    marked = mark_rows(hashed, quotas.where("need > 0").select(CLASS, "need"), ends["n"],
                       train.columns)
    times = F.col("_rounds") + (F.col(SPLIT) == TEST).cast("bigint")
    # A stored table of one row per class: the optimizer knows its size.
    joined = marked.join(quotas.select(F.col(CLASS).alias("_class"), F.col("rounds").alias("_rounds")),
                         quoted(target) == F.col("_class"))
    return joined.withColumn("_times", times).where("_times > 0").select(
        *[quoted(c) for c in train.columns],
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)).alias(COPY))


# ---- encodings ----------------------------------------------------------------------------------

def encode_ordinal(value: Column, order: Sequence[str]) -> Column:
    """Place of the trimmed value in its order, from 0; -1 for others, null for null."""
    if len(set(order)) != len(order):
        raise M.PreparationError("a value has two places in the order")
    text = normalize_category(value)
    return F.when(text.isNotNull(), (F.array_position(F.array(*map(F.lit, order)), text) - 1)
                  .cast("int"))


def fit_binary(train: DataFrame, column: str) -> list[str]:
    """The two values of a column, in the order of code points; another number of them is refused."""
    found = category_counts(train, [column]).where("value IS NOT NULL").select("value").limit(3).collect()
    if len(found) != 2:
        raise M.PreparationError(f"{column} has not exactly two values")
    return sorted(r["value"] for r in found)


def encode_binary(value: Column, values: Sequence[str]) -> Column:
    """0 for the first value, 1 for the second, null for null and anything new."""
    text = normalize_category(value)
    return F.when(text == values[0], 0).when(text == values[1], 1)


def fit_frequencies(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, share) over all training rows, stored; null is a value."""
    counts = materialize(category_counts(train, columns), "values")
    rows = counts.groupBy("column").agg(F.sum("n").alias("rows"))
    return materialize(counts.join(F.broadcast(rows), "column").select(
        "column", "value", (F.col("n") / F.col("rows")).alias("share")), "frequencies")


def encode_frequency(df: DataFrame, frequencies: DataFrame,
                     columns: Mapping[str, str]) -> DataFrame:
    """`df` with the share of every named column's value in training under its new name; 0 if new.

    A join per column with a stored table, whose size the optimizer knows.
    """
    taken = [n for n in columns.values() if n.lower() in (c.lower() for c in df.columns)]
    if taken:
        raise M.PreparationError("such columns exist already: " + ", ".join(taken))
    for name, output in columns.items():
        own = frequencies.where(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("share").alias("_share"))
        df = df.join(own, normalize_category(quoted(name)).eqNullSafe(F.col("_value")), "left").select(
            *[quoted(c) for c in df.columns], F.coalesce("_share", F.lit(0.0)).alias(output))
    return df
