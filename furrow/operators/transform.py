"""Applying a fitted state: a projection, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import normalize_category, quoted, strict_double
from furrow.operators.fit import ColumnState, FittedState


def output_names(state: FittedState) -> list[str]:
    """Output features in field order."""
    return [name for column in state.columns for name in _names(column)]


def _names(c: ColumnState) -> list[str]:
    names = []
    if c.dropped is None and c.kind == "numeric":
        names = [c.column]
    elif c.dropped is None:
        names = [f"{c.column}__category_{i:03d}" for i in range(len(c.categories))]
        names.append(c.unknown_output)
    if c.missing_indicator:
        names.append(c.missing_indicator)
    return names


def check_output(names: Sequence[str], target: str | None = None) -> None:
    """Refuse an output without features or with colliding names."""
    if not names:
        raise M.PreparationError("no feature is left after fitting")
    if len(set(names)) != len(names) or target in names:
        raise M.PreparationError("output names collide; rename the source columns")


def output_schema(state: FittedState, target: str | None = None) -> list[str]:
    """Checked output columns: features in field order, the target last."""
    names = output_names(state)
    check_output(names, target)
    return names + ([target] if target is not None else [])


def fill_number(value: Column, fill: float) -> Column:
    return F.coalesce(value, F.lit(fill))


def scale_number(value: Column, c: ColumnState) -> Column:
    if c.scaling == "standard":
        return (value - c.center) / F.lit(c.scale)
    if c.scaling == "minmax":
        return (value - c.minimum) / F.lit(c.scale)
    return value


def transform(df: DataFrame, state: FittedState, target: str | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """Output features of `df`, led by the columns in `keep` and followed by the target.

    The place of a category in its vocabulary is looked up once per row; the indicator columns
    then compare whole numbers.
    """
    types = {f.name: f.dataType for f in df.schema}
    ready, outputs = [], []
    for i, c in enumerate(state.columns):
        if c.dropped is None and c.kind == "numeric":
            value = fill_number(strict_double(quoted(c.column), types[c.column]), c.fill_num)
            ready.append(scale_number(value, c).alias(f"_v{i}"))
            outputs.append(F.col(f"_v{i}").alias(c.column))
        elif c.dropped is None:
            value = F.coalesce(normalize_category(quoted(c.column)), F.lit(c.fill_str))
            ready.append(category_place(value, c.categories).alias(f"_v{i}"))
            place = F.col(f"_v{i}")
            outputs += [(place == k + 1).cast("tinyint").alias(f"{c.column}__category_{k:03d}")
                        for k in range(len(c.categories))]
            outputs.append((place == 0).cast("tinyint").alias(c.unknown_output))
        if c.missing_indicator:
            ready.append(quoted(c.column).isNull().cast("tinyint").alias(f"_m{i}"))
            outputs.append(F.col(f"_m{i}").alias(c.missing_indicator))
    kept = [quoted(k) for k in keep]
    last = [quoted(target)] if target is not None else []
    inner = df.select(*[k.alias(f"_k{j}") for j, k in enumerate(kept)], *ready,
                      *[t.alias("_target") for t in last])
    return inner.select(
        *[F.col(f"_k{j}").alias(k) for j, k in enumerate(keep)], *outputs,
        *[F.col("_target").alias(target) for _ in last])


def category_place(value: Column, categories: Sequence[str]) -> Column:
    """1-based place in the vocabulary, 0 for a value outside of it."""
    if not categories:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in categories]), value),
                      F.lit(0)).cast("int")


def unknown_counts(transformed: DataFrame, state: FittedState) -> DataFrame:
    """(column, unknown): rows of each category column whose value training did not see."""
    columns = [c for c in state.columns if c.unknown_output and c.dropped is None]
    if not columns:
        spark = transformed.sparkSession
        return spark.range(0).selectExpr("cast(null as string) as column", "id as unknown")
    sums = transformed.agg(*[
        F.coalesce(F.sum(quoted(c.unknown_output).cast("bigint")), F.lit(0)).alias(f"_{i}")
        for i, c in enumerate(columns)
    ])
    cells = F.array(*[F.struct(F.lit(c.column).alias("column"), F.col(f"_{i}").alias("unknown"))
                      for i, c in enumerate(columns)])
    return sums.select(F.inline(cells))
