"""The preparation runs: supervised (split, fit on train, transform) and cleaning (whole table)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import model as M
from furrow.functions.text import quoted, strict_double, whole_row_token
from furrow.operators import split as S
from furrow.operators.fit import FittedState, fit, select_features
from furrow.operators.transform import output_schema, transform, unknown_counts
from furrow.session import materialize

ROW = "_row"


@dataclass
class PreparationRun:
    """Frames and records of one run. The frames are lazy; the records are small."""

    task: str
    config: M.PipelineConfig
    roles: dict[str, str]
    features: list[str]
    outputs: list[str]
    state: FittedState
    target: str | None = None
    stratified: bool = False
    frames: dict[str, DataFrame] = field(default_factory=dict)
    split: S.Split | None = None
    # Train and test as in `frames`, led by a token of the row that each row was made from.
    tokened: dict[str, DataFrame] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def unknown_counts(self) -> DataFrame:
        """Rows per category column that hold a value unseen in training, over the test part."""
        return unknown_counts(self.frames["test"], self.state)

    def transformed(self) -> DataFrame:
        """Train and test rows together, told apart by `split`, in one pass over the rows."""
        return transform(self.split.rows, self.state, self.target, keep=[S.SPLIT])


def run_preparation(df: DataFrame, roles: Mapping[str, str], task: str,
                    config: M.PipelineConfig | None = None,
                    enabled: Iterable[tuple[str | None, str]] = (),
                    key: Sequence[str] | None = None) -> PreparationRun:
    """Run the preparation that fits the task."""
    if task == M.CLEANING:
        return run_cleaning(df, roles, config, enabled)
    if task not in M.SUPERVISED:
        raise M.PreparationError(f"a {task} task is profiled but not run")
    return run_supervised(df, roles, task, config, enabled, key)


def run_supervised(df: DataFrame, roles: Mapping[str, str], task: str,
                   config: M.PipelineConfig | None = None,
                   enabled: Iterable[tuple[str | None, str]] = (),
                   key: Sequence[str] | None = None) -> PreparationRun:
    """Split first, fit on the training part, transform both parts with that state.

    `roles` are the confirmed roles of all columns in field order, `enabled` the (column, action)
    pairs of the enabled recommendations, `key` columns that identify a row.
    """
    config = config or M.PipelineConfig()
    targets = [c for c, role in roles.items() if role == M.TARGET]
    if len(targets) != 1:
        raise M.PreparationError("a supervised task needs exactly one target column")
    target = targets[0]
    features, indicators = select_features(roles, enabled)
    _check_schema(df, roles)
    df = _deduplicated(df, config)
    eligible = S.target_present(df, target)
    missing = S.target_missing(df, target)
    stratify = target if task == M.CLASSIFICATION and config.stratify_classification else None
    by_target = task == M.CLASSIFICATION
    classes = materialize(S.class_counts(eligible, target if by_target else None), "classes")
    _check_split(eligible, classes, target, task, config)
    split = S.split_rows(eligible, config.test_size, config.random_seed, key, stratify,
                         classes=classes if by_target == (stratify is not None) else None)
    # Every later pass reads one part, some columns of it, and no longer hashes and looks up.
    split.rows = materialize(split.rows, "split", S.SPLIT)
    raw_train, raw_test = split.part(S.TRAIN), split.part(S.TEST)
    numeric = [c for c in features if roles[c] in M.NUMERIC_ROLES]
    _check_numbers(eligible, numeric)
    state = fit(raw_train, roles, features, indicators, config)
    outputs = output_schema(state, target)
    names = list(key or df.columns)
    tokened = {part: transform(with_row_token(raw, names), state, target, keep=[ROW])
               for part, raw in (("train", raw_train), ("test", raw_test))}
    return PreparationRun(
        task, config, dict(roles), features, outputs[:-1], state, target, stratify is not None,
        {
            **{part: df.drop(ROW) for part, df in tokened.items()},
            "raw_train": raw_train, "raw_test": raw_test, "target_missing": missing,
        },
        split, tokened, names,
    )


def with_row_token(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """`df` with a token over the exact values of the key."""
    return df.withColumn(ROW, whole_row_token(df.schema, key))


def run_cleaning(df: DataFrame, roles: Mapping[str, str],
                 config: M.PipelineConfig | None = None,
                 enabled: Iterable[tuple[str | None, str]] = ()) -> PreparationRun:
    """Fit on the whole table and transform it; no target, no split."""
    config = config or M.PipelineConfig()
    if M.TARGET in roles.values():
        raise M.PreparationError("cleaning uses no target column")
    features, indicators = select_features(roles, enabled)
    _check_schema(df, roles)
    df = _deduplicated(df, config)
    state = fit(df, roles, features, indicators, config)
    outputs = output_schema(state)
    return PreparationRun(M.CLEANING, config, dict(roles), features, outputs, state,
                          frames={"processed": transform(df, state), "raw": df})


def _deduplicated(df: DataFrame, config: M.PipelineConfig) -> DataFrame:
    """Distinct rows, stored once because every later pass reads some columns of them."""
    return materialize(S.drop_duplicates(df), "rows") if config.drop_duplicates else df


def _check_schema(df: DataFrame, roles: Mapping[str, str]) -> None:
    drift = S.schema_drift(df.columns, list(roles))
    if drift:
        listed = ", ".join(f"{problem}: {column}" for problem, column in drift)
        raise M.PreparationError(f"the source does not match the confirmed fields ({listed})")


def _check_split(eligible: DataFrame, classes: DataFrame, target: str, task: str,
                 config: M.PipelineConfig) -> None:
    rejected = 0
    if task == M.REGRESSION and not isinstance(eligible.schema[target].dataType, T.NumericType):
        rejected = S.strict_numeric(eligible, [target]).head()["rejected"]
    problems = S.split_preconditions(classes, task, config, rejected).collect()
    if problems:
        listed = ", ".join(f"{p['problem']}: {p['found']} (needs {p['required']})"
                           for p in problems)
        raise M.PreparationError(f"the table cannot be split ({listed})")


def _check_numbers(df: DataFrame, columns: Sequence[str]) -> None:
    """Text in numeric columns is refused in both parts, not only where it was fitted."""
    types = {f.name: f.dataType.typeName() for f in df.schema}
    texts = [c for c in columns if types[c] == "string"]
    if texts:
        bad = S.strict_numeric(df, texts).where(F.col("rejected") > 0).collect()
        if bad:
            listed = ", ".join(f"{b['column']} ({b['rejected']})" for b in bad)
            raise M.PreparationError(f"values that are no numbers in: {listed}")


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """The rows with the target as a double; text that is no number is refused with its count."""
    _check_numbers(df, [target])
    return df.withColumn(target, strict_double(quoted(target), df.schema[target].dataType))
