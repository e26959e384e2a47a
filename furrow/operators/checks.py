"""Checks that a user states: keys that repeat, equal features with other targets, rules on values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import finite_double, quoted
from furrow.operators.fit import FittedState
from furrow.operators.transform import output_names

NOT_NULL, RANGE, UNIQUE, IN_SET, PATTERN, DATES = (
    "not_null", "range", "unique", "in_set", "pattern", "date_range")


def duplicates_by_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key columns and `n` of every key in more than one row; nulls are equal."""
    return df.groupBy(*[quoted(c) for c in key]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def target_conflicts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The features, `n` rows and `targets` of features that come with more than one target.

    Rows without a target are left out. Counted by features and target first, so features that many
    rows share are combined before the shuffle.
    """
    names = [quoted(c) for c in features]
    pairs = df.where(quoted(target).isNotNull()).groupBy(*names, quoted(target)).agg(
        F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(*names).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("targets")).where("targets > 1")


@dataclass
class Rule:
    """A rule on one column, or on several for `unique`. Null breaks only `not_null`."""

    name: str
    kind: str
    columns: list[str]
    low: float | str | None = None
    high: float | str | None = None
    values: list[str] = field(default_factory=list)
    pattern: str | None = None


def _broken(df: DataFrame, rule: Rule) -> Column:
    value = quoted(rule.columns[0])
    if rule.kind == NOT_NULL:
        return value.isNull()
    if rule.kind == IN_SET:
        return value.isNotNull() & ~value.cast("string").isin(rule.values)
    if rule.kind == PATTERN:
        return value.isNotNull() & ~value.cast("string").rlike(rule.pattern)
    if rule.kind == RANGE:
        # What is no finite number lies in no range.
        found, limit = finite_double(value, df.schema[rule.columns[0]].dataType), "double"
    else:
        found, limit = value.try_cast("timestamp"), "timestamp"
    outside = F.lit(False)
    if rule.low is not None:
        outside = outside | (found < F.lit(rule.low).cast(limit))
    if rule.high is not None:
        outside = outside | (found > F.lit(rule.high).cast(limit))
    return value.isNotNull() & (found.isNull() | outside)


def _check(df: DataFrame, rules: Sequence[Rule]) -> None:
    if len({r.name for r in rules}) != len(rules):
        raise M.PreparationError("two rules share a name")
    for rule in rules:
        if rule.kind not in (NOT_NULL, RANGE, UNIQUE, IN_SET, PATTERN, DATES):
            raise M.PreparationError(f"no such kind of rule: {rule.kind}")
        lost = [c for c in rule.columns if c not in df.columns]
        if lost or not rule.columns:
            raise M.PreparationError(f"rule {rule.name} has no column {', '.join(lost)}")
        if rule.kind != UNIQUE and len(rule.columns) != 1:
            raise M.PreparationError(f"rule {rule.name} takes one column")


def validate_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, kind, rows, violations) of every rule; rules on values take one pass together.

    A rule of uniqueness counts the rows beyond the first of each value (of several columns: each
    combination); a row with a null in them is left out.
    """
    _check(df, rules)
    plain = [r for r in rules if r.kind != UNIQUE]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count(F.when(_broken(df, r), 1)).alias(f"_v{i}") for i, r in enumerate(plain)])
    parts = [counts.select(F.inline(F.array(*[F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col("_rows").alias("rows"),
        F.col(f"_v{i}").alias("violations")) for i, r in enumerate(plain)])))] if plain else []
    for r in rules:
        if r.kind == UNIQUE:
            names = [quoted(c) for c in r.columns]
            whole = F.lit(True)
            for c in names:
                whole = whole & c.isNotNull()
            groups = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.count(
                F.when(whole, 1)).alias("_whole"))
            parts.append(groups.agg(
                F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.greatest(F.col("_whole") - 1, F.lit(0))), F.lit(0)).alias(
                    "violations")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def violations(df: DataFrame, rules: Sequence[Rule], column: str = "broken_rules") -> DataFrame:
    """The rows that break a rule on values, with the names of the rules they break."""
    _check(df, rules)
    if column.lower() in (c.lower() for c in df.columns):
        raise M.PreparationError(f"a column is named {column} already")
    plain = [r for r in rules if r.kind != UNIQUE]
    names = F.filter(F.array(F.lit(None).cast("string"), *[
        F.when(_broken(df, r), F.lit(r.name)) for r in plain]), lambda x: x.isNotNull())
    return df.withColumn(column, names).where(F.size(column) > 0)


def resource_estimate(df: DataFrame, state: FittedState) -> DataFrame:
    """One row: rows, input_bytes, output_columns, output_bytes, before anything is transformed.

    Text counts by its bytes, a number, time or truth value by 8; the output holds 8 bytes a number
    and 1 an indicator. One pass over the columns that the state uses.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema}
    size = F.lit(0).cast("bigint")
    for c in state.columns:
        value = quoted(c.column)
        size = size + F.coalesce(F.octet_length(value) if types[c.column] == "string" else F.when(
            value.isNotNull(), 8), F.lit(0))
    numbers = sum(c.kind == "numeric" and c.dropped is None for c in state.columns)
    width = len(output_names(state))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("input_bytes"),
        F.lit(width).alias("output_columns"),
        (F.count(F.lit(1)) * F.lit(8 * numbers + width - numbers)).alias("output_bytes"))
