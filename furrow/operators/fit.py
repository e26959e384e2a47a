"""Learning imputation, scaling and vocabularies from the training rows.

What is learned is small: one record per input column with at most `max_categories` values.
Numeric columns take one pass without a shuffle: the moments after filling follow from the
moments of the present values, the fill, and the counts. Categorical columns take one grouped
count of their values. Exact medians are found by counting into buckets.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import model as M
from furrow.functions.text import finite_double, normalize_category, quoted
from furrow.session import small_table

# Columns per aggregate query; more would make one oversized generated method.
COLUMNS_PER_PASS = 24
# Values per column that the last step of the bucket search may bring to one task.
FINAL_VALUES = 100_000
BUCKETS = 4_096


@dataclass
class ColumnState:
    """All that one input column needs to be transformed."""

    column: str
    ordinal: int
    kind: str
    imputation: str | None = None
    fill_num: float | None = None
    fill_str: str | None = None
    scaling: str | None = None
    center: float | None = None
    scale: float | None = None
    minimum: float | None = None
    maximum: float | None = None
    categories: list[str] = field(default_factory=list)
    truncated: bool | None = None
    unknown_output: str | None = None
    dropped: str | None = None
    missing_indicator: str | None = None


STATE_SCHEMA = (
    "column string, ordinal int, kind string, imputation string, fill_num double, "
    "fill_str string, scaling string, center double, scale double, minimum double, "
    "maximum double, categories array<string>, truncated boolean, unknown_output string, "
    "dropped string, missing_indicator string"
)


@dataclass
class FittedState:
    """The learned record of every input column, in field order; plain JSON, no code."""

    columns: list[ColumnState]
    version: int = 1

    def to_json(self) -> str:
        payload = {"version": self.version, "columns": [asdict(c) for c in self.columns]}
        return json.dumps(payload, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> FittedState:
        payload = json.loads(text)
        known = {f.name for f in fields(ColumnState)}
        columns = [ColumnState(**{k: v for k, v in c.items() if k in known})
                   for c in payload["columns"]]
        return FittedState(columns, payload["version"])

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(asdict(c).values()) for c in self.columns]
        return small_table(spark, rows, STATE_SCHEMA)

    @staticmethod
    def from_dataframe(df: DataFrame) -> FittedState:
        rows = df.orderBy("ordinal").collect()
        return FittedState([ColumnState(**{**r.asDict(), "categories": list(r["categories"] or [])})
                            for r in rows])


# ---- feature selection ------------------------------------------------------------------------

def select_features(roles: Mapping[str, str], enabled: Iterable[tuple[str | None, str]] = ()
                    ) -> tuple[list[str], list[str]]:
    """Feature columns and those of them that get a missing indicator.

    `roles` are in field order; `enabled` are (column, action) of the enabled recommendations.
    """
    enabled = list(enabled)
    removed = {c for c, action in enabled if action in (M.REMOVE_COLUMN, M.EXCLUDE_FEATURE)}
    marked = {c for c, action in enabled if action == M.ADD_MISSING_INDICATOR}
    chosen = [c for c, role in roles.items()
              if role not in M.EXCLUDED_ROLES and role != M.TARGET and c not in removed]
    usable = M.NUMERIC_ROLES + M.CATEGORICAL_ROLES
    refused = [c for c in chosen if roles[c] not in usable]
    if refused:
        raise M.PreparationError(f"no transformation for the role of: {', '.join(refused)}")
    if not chosen:
        raise M.PreparationError("no feature columns are left")
    return chosen, [c for c in chosen if c in marked]


def feature_plan(profile: DataFrame, recs: DataFrame) -> DataFrame:
    """The same choice as a table: (ordinal, column, role, missing_indicator) per feature."""
    on = recs.where("enabled")
    removed = on.where(F.col("action").isin(M.REMOVE_COLUMN, M.EXCLUDE_FEATURE)).select("column")
    marked = on.where(F.col("action") == M.ADD_MISSING_INDICATOR).select(
        "column", F.lit(True).alias("missing_indicator")).distinct()
    usable = ~F.col("role").isin(*M.EXCLUDED_ROLES, M.TARGET)
    return (
        profile.where(usable).select("ordinal", "column", "role")
        .join(removed, "column", "left_anti").join(marked, "column", "left")
        .select("ordinal", "column", "role",
                F.coalesce("missing_indicator", F.lit(False)).alias("missing_indicator"))
    )


# ---- fitting ------------------------------------------------------------------------------------

def fit(train: DataFrame, roles: Mapping[str, str], features: Sequence[str],
        indicators: Sequence[str], config: M.PipelineConfig) -> FittedState:
    """Learn the state of all feature columns from `train` and nothing else."""
    numeric = [c for c in features if roles[c] in M.NUMERIC_ROLES]
    categorical = [c for c in features if c not in numeric]
    learned = {
        **fit_numeric(train, numeric, config),
        **fit_categorical(train, categorical, config),
    }
    states = []
    for ordinal, name in enumerate(features):
        state = learned[name]
        state.ordinal = ordinal
        if name in indicators:
            state.missing_indicator = f"{name}__is_missing"
        states.append(state)
    return FittedState(states)


def fit_numeric(train: DataFrame, columns: Sequence[str],
                config: M.PipelineConfig) -> dict[str, ColumnState]:
    facts = numeric_facts(train, columns, config.numeric_imputation == "median")
    bad = {c: f["rejected"] for c, f in facts.items() if f["rejected"]}
    if bad:
        listed = ", ".join(f"{c} ({n})" for c, n in bad.items())
        raise M.PreparationError(f"values that are no finite numbers in: {listed}")
    return {c: _numeric_state(c, f, config) for c, f in facts.items()}


def numeric_facts(train: DataFrame, columns: Sequence[str], median: bool = True,
                  final_values: int | None = None) -> dict[str, dict[str, float]]:
    """Counts, moments, range and exact median of the present values of each column.

    NaN and infinite values count as rejected, like text that is no number; they enter neither
    moments nor median.
    """
    types = {f.name: f.dataType for f in train.schema}
    facts: dict[str, dict[str, float]] = {}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[start:start + COLUMNS_PER_PASS]
        values = [finite_double(quoted(c), types[c]).alias(f"_x{i}") for i, c in enumerate(chunk)]
        bad = {i: (quoted(c).isNotNull() & finite_double(quoted(c), types[c]).isNull())
               .cast("bigint").alias(f"_bad{i}")
               for i, c in enumerate(chunk)
               if not isinstance(types[c], (T.IntegralType, T.DecimalType))}
        row = train.select(*values, *bad.values()).agg(*[
            F.expr(_measures(i, i in bad)).alias(f"_{i}") for i in range(len(chunk))
        ]).head()
        facts.update({c: row[f"_{i}"].asDict() for i, c in enumerate(chunk)})
    if median:
        for c, value in exact_medians(train, columns, facts,
                                      final_values or FINAL_VALUES).items():
            facts[c]["median"] = value
    return facts


def _measures(i: int, checked: bool) -> str:
    """One SQL expression per column; building it from parts costs more than running it."""
    rejected = f"coalesce(sum(_bad{i}), 0)" if checked else "0L"
    return (f"struct(count(1) AS rows, count(_x{i}) AS present, {rejected} AS rejected, "
            f"avg(_x{i}) AS mean, var_pop(_x{i}) AS variance, min(_x{i}) AS low, "
            f"max(_x{i}) AS high)")


def _numeric_state(name: str, f: Mapping[str, float], config: M.PipelineConfig) -> ColumnState:
    present, holes = f["present"], f["rows"] - f["present"]
    if present == 0:
        if config.drop_constant_features:
            return ColumnState(name, 0, "numeric", dropped=M.ALL_MISSING)
        raise M.PreparationError(f"column {name} has no value in the training rows")
    fill = f["mean"] if config.numeric_imputation == "mean" else f["median"]
    if config.drop_constant_features and f["low"] == f["high"]:
        return ColumnState(name, 0, "numeric", fill_num=fill, dropped=M.CONSTANT)
    state = ColumnState(name, 0, "numeric", imputation=config.numeric_imputation, fill_num=fill,
                        scaling=config.scaling)
    if config.scaling == "standard":
        state.center, state.scale = filled_moments(present, f["mean"], f["variance"], holes, fill)
    elif config.scaling == "minmax":
        # A mean or median lies inside the range, so filling does not widen it.
        state.minimum, state.maximum = f["low"], f["high"]
        state.scale = (f["high"] - f["low"]) or 1.0
    return state


def filled_moments(present: int, mean: float, variance: float, holes: int,
                   fill: float) -> tuple[float, float]:
    """Mean and population deviation after `holes` cells got the value `fill`; 0 becomes 1."""
    total = present + holes
    center = mean + (fill - mean) * (holes / total)
    spread = ((variance + (mean - center) ** 2) * (present / total)
              + (fill - center) ** 2 * (holes / total))
    return center, math.sqrt(spread) or 1.0


# ---- exact medians of large columns ---------------------------------------------------------------

def exact_medians(df: DataFrame, columns: Sequence[str],
                  facts: Mapping[str, Mapping[str, float]],
                  final_values: int = FINAL_VALUES) -> dict[str, float | None]:
    """The interpolated median of each column, exactly, without gathering a column anywhere.

    Per column the two middle ranks are located by counting values into ordered buckets: first
    one bucket per sign and binary exponent, then equal widths inside the bucket that holds the
    ranks. Each step is one pass over the columns still open and shuffles a few thousand counts.
    A bucket that came down to `final_values` values is read out.
    """
    result: dict[str, float | None] = {}
    open_: dict[str, _Range] = {}
    for c in columns:
        n = facts[c]["present"]
        if n == 0:
            result[c] = None
        else:
            open_[c] = _Range(facts[c]["low"], facts[c]["high"], n, (n - 1) // 2, n // 2, True)
    while open_:
        for c in [c for c, r in open_.items() if r.low == r.high]:
            result[c] = open_.pop(c).low
        last = {c: r for c, r in open_.items() if r.count <= final_values}
        result.update(_read_out(df, last))
        open_ = {c: r for c, r in open_.items() if c not in last}
        for c, buckets in _bucket_counts(df, open_).items():
            settled = open_[c].descend(buckets)
            if settled is not None:
                result[c] = settled
                open_.pop(c)
    return result


def _midpoint(low: float, high: float) -> float:
    total = low + high
    return total / 2 if math.isfinite(total) else low / 2 + high / 2


@dataclass
class _Range:
    """Where the middle ranks `first` and `second` (counted from `low`) of a column lie."""

    low: float
    high: float
    count: int
    first: int
    second: int
    by_exponent: bool

    def bucket(self, x: Column) -> Column:
        """Number of the bucket of x, never decreasing in x."""
        if self.by_exponent:
            exponent = F.coalesce(F.floor(F.log2(F.abs(x))), F.lit(-1100))
            return (F.signum(x) * (exponent + 1101)).cast("bigint")
        width = (self.high / BUCKETS - self.low / BUCKETS) or math.ulp(0.0)
        return F.least(F.floor((x - self.low) / F.lit(width)), F.lit(BUCKETS - 1)).cast("bigint")

    def descend(self, buckets: Sequence) -> float | None:
        """Move to the bucket with both ranks; a value if they fall apart."""
        seen = 0
        for i, b in enumerate(buckets):
            if self.first < seen + b["n"]:
                if self.second >= seen + b["n"]:
                    return _midpoint(b["high"], buckets[i + 1]["low"])
                self.first, self.second = self.first - seen, self.second - seen
                self.low, self.high, self.count = b["low"], b["high"], b["n"]
                self.by_exponent = False
                return None
            seen += b["n"]
        raise AssertionError("a rank lies outside the counted values")


def _inside(df: DataFrame, ranges: Mapping[str, _Range]) -> list[tuple[str, Column]]:
    types = {f.name: f.dataType for f in df.schema}
    cells = []
    for c, r in ranges.items():
        x = finite_double(quoted(c), types[c])
        cells.append((c, F.when(x.between(r.low, r.high), x)))
    return cells


def _bucket_counts(df: DataFrame, ranges: Mapping[str, _Range]) -> dict[str, list]:
    """Ordered (n, low, high) of the non-empty buckets of every open column."""
    found: dict[str, list] = {c: [] for c in ranges}
    if not ranges:
        return found
    names = list(ranges)
    wide = df.select(*[x.alias(f"_{i}") for i, (_, x) in enumerate(_inside(df, ranges))])
    cells = F.array(*[
        F.struct(F.lit(i).alias("at"), ranges[c].bucket(F.col(f"_{i}")).alias("bucket"),
                 F.col(f"_{i}").alias("x")) for i, c in enumerate(names)
    ])
    counted = (
        wide.select(F.inline(cells)).where(F.col("x").isNotNull()).groupBy("at", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("at", "bucket")
    )
    for row in counted.collect():
        found[names[row["at"]]].append(row)
    return found


def _read_out(df: DataFrame, ranges: Mapping[str, _Range]) -> dict[str, float]:
    """The median inside ranges that are known to hold few values."""
    if not ranges:
        return {}
    names = list(ranges)
    wide = df.select(*[x.alias(f"_{i}") for i, (_, x) in enumerate(_inside(df, ranges))])
    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"_{i}").alias("x"))
                      for i in range(len(names))])
    values = wide.select(F.inline(cells)).where(F.col("x").isNotNull())
    ranked = values.withColumn(
        "rank", F.row_number().over(Window.partitionBy("at").orderBy("x")) - 1)
    wanted = F.lit(False)
    for i, c in enumerate(names):
        wanted = wanted | ((F.col("at") == i) & F.col("rank").isin(ranges[c].first,
                                                                  ranges[c].second))
    middle = ranked.where(wanted).groupBy("at").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return {names[r["at"]]: _midpoint(r["a"], r["b"]) for r in middle.collect()}


# ---- categories -----------------------------------------------------------------------------------

def category_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of normalized categories, null included, over all columns at once."""
    return (
        train.select(*[normalize_category(quoted(c)).alias(c) for c in columns])
        .unpivot([], [quoted(c) for c in columns], "column", "value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(counts: DataFrame, max_categories: int) -> DataFrame:
    """(column, value, n, place): the most frequent values, ties by code point.

    The rank filter is also applied before the shuffle, so a column with very many values sends
    at most `max_categories` of them from each task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= max_categories)
    )


def category_facts(counts: DataFrame) -> DataFrame:
    """(column, distinct, missing): present distinct values and missing rows per column."""
    return counts.groupBy("column").agg(
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
    )


def with_missing_label(counts: DataFrame) -> DataFrame:
    """Value counts after nulls were filled with the missing label."""
    label = F.coalesce("value", F.lit(M.MISSING_LABEL)).alias("value")
    return counts.groupBy("column", label).agg(F.sum("n").alias("n"))


def fit_categorical(train: DataFrame, columns: Sequence[str],
                    config: M.PipelineConfig) -> dict[str, ColumnState]:
    if not columns:
        return {}
    label = config.categorical_imputation == "missing_category"
    counts = category_counts(train, columns)
    if label:
        counts = with_missing_label(counts)
    top = vocabulary(counts, config.max_categories).select(
        "column", "value", F.col("place").cast("bigint").alias("place"),
        F.lit(None).cast("bigint").alias("distinct"))
    facts = category_facts(counts).select(
        "column", F.lit(None).cast("string").alias("value"),
        F.col("missing").alias("place"), "distinct")
    kept: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    distinct = dict.fromkeys(columns, 0)
    missing = dict.fromkeys(columns, 0)
    for row in top.unionByName(facts).collect():
        if row["distinct"] is None:
            kept[row["column"]].append((row["place"], row["value"]))
        else:
            distinct[row["column"]] = row["distinct"]
            missing[row["column"]] = row["place"]
    return {c: _category_state(c, [v for _, v in sorted(kept[c])], distinct[c], missing[c], config)
            for c in columns}


def _category_state(name: str, values: list[str], distinct: int, missing: int,
                    config: M.PipelineConfig) -> ColumnState:
    most_frequent = config.categorical_imputation == "most_frequent"
    fill = values[0] if most_frequent and values else M.MISSING_LABEL
    if not values and missing:
        # Nothing was observed, so every training row is filled with the label.
        values, distinct = [M.MISSING_LABEL], 1
    if config.drop_constant_features and distinct <= 1:
        return ColumnState(name, 0, "categorical", fill_str=fill, dropped=M.CONSTANT)
    return ColumnState(
        name, 0, "categorical", imputation=config.categorical_imputation, fill_str=fill,
        categories=values, truncated=distinct > len(values), unknown_output=f"{name}__unknown",
    )
