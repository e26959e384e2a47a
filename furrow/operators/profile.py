"""Column profiles: types, missing and distinct counts, examples, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.text import NUMBER, quoted
from furrow.functions.types import NESTED_NAMES, comparable, count_type, type_name
from furrow.model import EXAMPLES, PREVIEW_ROWS, SAMPLE_ROWS
from furrow.session import materialize, small_table

# Long texts are counted by digest, so a shuffle never carries them whole.
DIGEST_ABOVE = 64
# Rows per task that a single merging task may receive; above it, merging has two levels.
PLAIN_TOP = 16
MERGE_TASKS = 512
HEAD_ROWS = 16
WHOLE = r"^[+-]?[0-9]{1,19}$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$"
# Up to this rank Spark drops rows of a ranked window before they are shuffled.
EARLY_RANK = "spark.sql.optimizer.windowGroupLimitThreshold"


# ---- row-order operators ----------------------------------------------------------------

def first_rows(df: DataFrame, order_by: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first `n` rows in key order.

    A small `n` is one top-k: every task keeps n rows and one task merges them. For a large `n`
    the merge would receive n rows from every task of the scan, so the candidates are first cut
    to n rows in each of 512 groups of tasks; every task drops all but its own first n rows
    before that shuffle.
    """
    keys = [quoted(c) for c in order_by]
    if n > PLAIN_TOP:
        spark = df.sparkSession
        if int(spark.conf.get(EARLY_RANK)) < n:
            spark.conf.set(EARLY_RANK, str(n))
        group = Window.partitionBy("_group").orderBy(*keys)
        df = (
            df.withColumn("_group", F.spark_partition_id() % MERGE_TASKS)
            .withColumn("_rank", F.row_number().over(group))
            .where(F.col("_rank") <= n)
            .drop("_group", "_rank")
        )
    return df.orderBy(*keys).limit(n)


def head_sample(df: DataFrame, order_by: Sequence[str],
                n: int = SAMPLE_ROWS) -> tuple[DataFrame, bool]:
    """First `n` rows and whether the table has more than that."""
    return first_rows(df, order_by, n), has_more(df, n)


def has_more(df: DataFrame, n: int) -> bool:
    """Whether a table has more than a few rows; reads only as many partitions as that takes."""
    return len(df.select(F.lit(1)).take(n + 1)) > n


def preview_rows(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First rows with every cell as text; null stays null."""
    return first_rows(df, order_by, n).select(
        *[_as_text(quoted(f.name), f.dataType).alias(f.name) for f in df.schema]
    )


# ---- per-column statistics --------------------------------------------------------------

def schema_infer(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type name."""
    rows = [(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema)]
    return small_table(df.sparkSession, rows, "ordinal int, column string, inferred_type string")


def text_types(df: DataFrame, dates: bool = False) -> DataFrame:
    """(column, inferred_type) of text columns, from what all of their values can be read as.

    One aggregate pass over all columns. A column without values stays text. Dates are only
    recognized on request, since text files keep them as text.
    """
    readings = {
        "Int64": lambda c: c.rlike(WHOLE) & c.try_cast("bigint").isNotNull(),
        "Float64": lambda c: c.rlike(NUMBER),
        "Boolean": lambda c: F.lower(c).isin("true", "false"),
    }
    if dates:
        readings["Datetime"] = lambda c: c.rlike(DATE) & c.try_cast("timestamp_ntz").isNotNull()
    counts = df.agg(*[
        F.struct(F.count(quoted(c)).alias("present"), *[
            F.count(F.when(fits(quoted(c)), 1)).alias(kind) for kind, fits in readings.items()
        ]).alias(f"_{i}") for i, c in enumerate(df.columns)
    ])

    def kind(i: int) -> Column:
        fitting = F.lit("String")
        for name in reversed(readings):
            all_fit = F.col(f"_{i}.{name}") == F.col(f"_{i}.present")
            fitting = F.when(all_fit & (F.col(f"_{i}.present") > 0), name).otherwise(fitting)
        return fitting

    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), kind(i).alias("inferred_type"))
        for i, c in enumerate(df.columns)
    ])))


def typed(df: DataFrame, dates: bool = False) -> DataFrame:
    """Text columns in the types that all of their values fit."""
    casts = {"Int64": "bigint", "Float64": "double", "Boolean": "boolean",
             "Datetime": "timestamp_ntz", "String": "string"}
    found = {r["column"]: casts[r["inferred_type"]] for r in text_types(df, dates).collect()}
    return df.select(*[quoted(c).cast(found[c]).alias(c) for c in df.columns])


def missing_stats(df: DataFrame) -> DataFrame:
    """Rows and missing cells per column, in one pass without a data shuffle."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(quoted(f.name)).alias(f"_{i}") for i, f in enumerate(df.schema)],
    )
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f"_{i}").alias("present"))
        for i, f in enumerate(df.schema)
    ])
    return counts.select("rows", F.inline(cells)).select(
        "column", "rows", *_missing(F.col("rows"), F.col("rows") - F.col("present"))
    )


def unique_stats(df: DataFrame, exact: bool = True,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values per column; null counts as one of them.

    The approximate form needs no shuffle of the values and is only used when asked for.
    """
    if exact:
        return _distinct(df, columns).select("column", "unique_count")
    wanted = list(columns or df.columns)
    names = [f.name for f in df.schema if f.name in wanted and comparable(f.dataType)]
    sketched = df.agg(*[
        (F.approx_count_distinct(quoted(n))
         + F.coalesce(F.max(quoted(n).isNull().cast("int")), F.lit(0))).alias(f"_{i}")
        for i, n in enumerate(names)
    ])
    cells = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"_{i}").cast("bigint").alias("unique_count"))
        for i, n in enumerate(names)
    ])
    return sketched.select(F.inline(cells))


def example_values(df: DataFrame, order_by: Sequence[str], n: int = EXAMPLES,
                   head: int = HEAD_ROWS) -> DataFrame:
    """The first `n` present values of every column as text, in key order.

    One top-k of `head` rows settles every column that is not almost empty there. Each column
    left over gets a top-k of its own over (keys, column), whose not-null filter reaches the
    scan. No group ever holds more than `head` rows.
    """
    keys = list(order_by)
    names = [f.name for f in df.schema]
    top = first_rows(df, keys, head)
    found = {r["column"]: r["examples"] for r in _examples_of(top, keys, names, n).collect()}
    sparse = [c for c in names if len(found.get(c, ())) < n]
    if sparse and has_more(df, head):
        own = _union([
            _examples_of(
                first_rows(df.select(*_distinct_names([*keys, c])).where(quoted(c).isNotNull()),
                           keys, n),
                keys, [c], n)
            for c in sparse
        ])
        found.update({r["column"]: r["examples"] for r in own.collect()})
    rows = [(c, list(found.get(c, []))) for c in names]
    return small_table(df.sparkSession, rows, "column string, examples array<string>")


def column_profile(df: DataFrame, order_by: Sequence[str], exact: bool = True) -> DataFrame:
    """One row per column: type, missing count and rate, distinct count, examples."""
    base = schema_infer(df)
    examples = example_values(df, order_by)
    if exact:
        counted = _distinct(df)
        nested = [f.name for f in df.schema if not comparable(f.dataType)]
        if nested:
            counted = counted.unionByName(
                missing_stats(df.select(*[quoted(c) for c in nested]))
                .select("column", "rows", "missing_count",
                        F.lit(None).cast("bigint").alias("unique_count"))
            )
    else:
        counted = missing_stats(df).join(unique_stats(df, exact=False), "column", "left")
        counted = counted.select("column", "rows", "missing_count", "unique_count")
    rows, missing = F.coalesce("rows", F.lit(0)), F.coalesce("missing_count", F.lit(0))
    unique = F.when(F.col("inferred_type").isin(*NESTED_NAMES),
                    F.col("unique_count")).otherwise(F.coalesce("unique_count", F.lit(0)))
    # Both small sides hold one row per column of the table.
    return (
        F.broadcast(base).join(counted, "column", "left")
        .join(F.broadcast(examples), "column", "left")
        .select("ordinal", "column", "inferred_type", rows.alias("rows"),
                *_missing(rows, missing), unique.alias("unique_count"), "examples")
    )


def stored_profile(df: DataFrame, order_by: Sequence[str], exact: bool = True) -> DataFrame:
    """The column profile as a stored table, for the many small results that build on it.

    Roles, scores and recommendations each read it several times; none may scan the data again.
    """
    return materialize(column_profile(df, order_by, exact), "profile")


def dataset_profile(df: DataFrame, order_by: Sequence[str],
                    sample_rows: int | None = None) -> DataFrame:
    """The table-level row: rows profiled, whether that is a sample, width, totals.

    With `sample_rows` the profile covers only the first rows, as an interactive tool would;
    by default it covers the whole table.
    """
    is_sampled = False
    if sample_rows is not None:
        df, is_sampled = head_sample(df, order_by, sample_rows)
    note = f"profile of the first {sample_rows} rows" if is_sampled else None
    return missing_stats(df).agg(
        F.max("rows").alias("sampled_rows"),
        F.lit(is_sampled).alias("is_sampled"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
        F.lit(note).cast("string").alias("warning"),
    )


# ---- helpers ----------------------------------------------------------------------------

def _as_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def _missing(rows: Column, missing: Column) -> list[Column]:
    rate = F.when(rows > 0, missing / rows).otherwise(F.lit(0.0))
    return [missing.cast("bigint").alias("missing_count"), rate.alias("missing_rate")]


def _families(df: DataFrame, columns: Sequence[str] | None) -> dict[str, list[str]]:
    families: dict[str, list[str]] = {}
    for field in df.schema:
        family = count_type(field.dataType)
        if family and (columns is None or field.name in columns):
            families.setdefault(family, []).append(field.name)
    return families


def _stack(df: DataFrame, names: Sequence[str], family: str) -> DataFrame:
    def cell(name: str) -> Column:
        value = quoted(name).cast(family)
        if family == "string":
            value = F.when(F.length(value) <= DIGEST_ABOVE, value).otherwise(
                F.concat(F.lit("sha256:"), F.sha2(value.cast("binary"), 256)))
        return value.alias(name)

    return df.select(*[cell(n) for n in names]).unpivot(
        [], [quoted(n) for n in names], "column", "value"
    )


def _distinct(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, missing and distinct counts per column out of the value counts."""
    parts = []
    for family, names in _families(df, columns).items():
        counted = _stack(df, names, family).groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("n"))
        parts.append(counted.groupBy("column").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
            .alias("missing_count"),
            F.count(F.lit(1)).alias("unique_count"),
        ))
    return _union(parts)


def _examples_of(top: DataFrame, keys: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
    """Examples out of a frame that already is bounded to a few rows."""
    types = {f.name: f.dataType for f in top.schema}
    rank = Window.orderBy(*[quoted(k) for k in keys])
    text = top.withColumn("_at", F.row_number().over(rank)).select(
        "_at", *[_as_text(quoted(c), types[c]).alias(c) for c in names])
    cells = text.unpivot(["_at"], [quoted(c) for c in names], "column", "value")
    found = F.sort_array(F.collect_list(F.struct("_at", "value")))
    return cells.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.transform(F.slice(found, 1, n), lambda s: s["value"]).alias("examples"))


def _distinct_names(names: Sequence[str]) -> list[Column]:
    return [quoted(c) for c in dict.fromkeys(names)]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
