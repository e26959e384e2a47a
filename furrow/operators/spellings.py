"""Categories that differ in case only, or by a slip or two of the pen.

Works on the frequency table of a column, one row per different value. Two values within an edit
distance of d have a string in common that is left when up to d characters are deleted from each.
So every short value is listed under all strings that such deletions leave, and values that meet
under one of them are compared. Long values have too many; of d + 1 pieces of such a value one
must stand unchanged in any value within distance d, moved by d places at most, so they are listed
under their pieces and looked up under the places where a piece may have come to stand.
Both are joins on equality; no value is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import normalize_category, quoted
from furrow.session import materialize

MOST_EDITS, LEAST_LENGTH = 2, 5
# Values up to this length, and those within the distance of it, go by deletions.
SHORT = 24


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the present values of a column, trimmed."""
    return df.select(normalize_category(quoted(column)).alias("value")).where(
        "value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


def case_variants(counts: DataFrame) -> DataFrame:
    """(value, n, suggestion): forms of one word in different case, and the most frequent form.

    Of equally frequent forms the lowest by code points is suggested. The suggested form itself is
    listed too; words of one form are not.
    """
    folded = F.lower("value")
    best = counts.groupBy(folded.alias("folded")).agg(
        F.count("*").alias("forms"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("best")).where("forms > 1")
    return counts.withColumn("folded", folded).join(best, "folded").select(
        "value", "n", F.col("best.value").alias("suggestion"))


def _without_one(text: Column) -> Column:
    """The strings left when one character is deleted."""
    return F.when(F.length(text) > 0, F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(
            text, i + 1, F.length(text))))).otherwise(F.array().cast("array<string>"))


def _deletions(text: Column, edits: int) -> Column:
    left = layer = F.array(text)
    for _ in range(edits):
        layer = F.array_distinct(F.flatten(F.transform(layer, _without_one)))
        left = F.concat(left, layer)
    return F.array_distinct(left)


def _piece(text: Column, length: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a numbered piece of a text of `length` characters."""
    start = F.floor(length * number / (edits + 1)).cast("int")
    end = F.floor(length * (number + 1) / (edits + 1)).cast("int")
    return start, end - start


def _met_by_deletions(values: DataFrame, edits: int) -> DataFrame:
    listed = values.where(F.length("value") <= SHORT + edits).select(
        "value", "n", F.explode(_deletions(F.col("value"), edits)).alias("left"))
    # Digests keep the rows small; what is compared are the values.
    listed = listed.select(F.xxhash64("left").alias("k"), "value", "n")
    return _pairs(listed, listed)


def _met_by_pieces(values: DataFrame, edits: int) -> DataFrame:
    text, length = F.col("value"), F.length("value")
    long_ones = values.where(length > SHORT)
    numbers = F.sequence(F.lit(0), F.lit(edits))

    def own(i: Column) -> Column:
        start, size = _piece(text, length, i, edits)
        return F.xxhash64(length, i, F.substring(text, start + 1, size))

    def elsewhere(wanted: Column) -> Column:
        def shifted(i: Column) -> Column:
            start, size = _piece(text, wanted, i, edits)
            places = F.filter(F.sequence(start - edits, start + edits),
                              lambda at: (at >= 0) & (at + size <= length))
            return F.transform(places, lambda at: F.xxhash64(wanted, i, F.substring(
                text, at + 1, size)))
        return F.flatten(F.transform(numbers, shifted))

    listed = long_ones.select(F.explode(F.transform(numbers, own)).alias("k"), "value", "n")
    lengths = F.sequence(length - edits, length + edits)
    asked = long_ones.select(F.explode(F.array_distinct(F.flatten(F.transform(
        lengths, elsewhere)))).alias("k"), "value", "n")
    return _pairs(listed, asked)


def _pairs(listed: DataFrame, asked: DataFrame) -> DataFrame:
    left = listed.select("k", F.col("value").alias("a"), F.col("n").alias("n_a"))
    right = asked.select("k", F.col("value").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, "k").where("a <> b").drop("k")
    one_way = F.col("a") < F.col("b")
    return met.select(F.least("a", "b").alias("value"), F.greatest("a", "b").alias("other"),
                      F.when(one_way, F.col("n_a")).otherwise(F.col("n_b")).alias("n"),
                      F.when(one_way, F.col("n_b")).otherwise(F.col("n_a")).alias("other_n"))


def near_spellings(counts: DataFrame, edits: int = MOST_EDITS,
                   least_length: int = LEAST_LENGTH) -> DataFrame:
    """(value, other, n, other_n, distance, suggestion) of values within an edit distance.

    Every pair once, the lower value by code points first; both have `least_length` characters or
    more. The suggestion is the more frequent one, of equal ones the lower.
    """
    values = materialize(counts.where(F.length("value") >= least_length), "spellings")
    met = _met_by_deletions(values, edits).unionByName(_met_by_pieces(values, edits)).distinct()
    distance = F.levenshtein("value", "other", edits)
    return met.withColumn("distance", distance).where("distance >= 0").withColumn(
        "suggestion", F.when(F.col("other_n") > F.col("n"), F.col("other")).otherwise(
            F.col("value")))
