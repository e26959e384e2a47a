"""Vocabulary of the engine: tasks, column roles, knobs and fixed texts."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# ---- fixed values -------------------------------------------------------------------------
CLASSIFICATION = "classification"
REGRESSION = "regression"
CLUSTERING_PREP = "clustering_prep"
CLEANING = "cleaning"
TASKS = (CLASSIFICATION, REGRESSION, CLUSTERING_PREP, CLEANING)
SUPERVISED = (CLASSIFICATION, REGRESSION)

CONTINUOUS_NUMERIC = "continuous_numeric"
DISCRETE_NUMERIC = "discrete_numeric"
NOMINAL_CATEGORY = "nominal_category"
ORDINAL_CATEGORY = "ordinal_category"
BOOLEAN = "boolean"
DATETIME = "datetime"
ID = "id"
TEXT = "text"
TARGET = "target"
GROUP = "group"
SENSITIVE = "sensitive"
IGNORE = "ignore"
ROLES = (
    CONTINUOUS_NUMERIC, DISCRETE_NUMERIC, NOMINAL_CATEGORY, ORDINAL_CATEGORY, BOOLEAN, DATETIME,
    ID, TEXT, TARGET, GROUP, SENSITIVE, IGNORE,
)
NUMERIC_ROLES = (CONTINUOUS_NUMERIC, DISCRETE_NUMERIC)
CATEGORICAL_ROLES = (NOMINAL_CATEGORY, ORDINAL_CATEGORY, BOOLEAN)
EXCLUDED_ROLES = (ID, TEXT, GROUP, SENSITIVE, IGNORE)

MISSING_LABEL = "__MISSING__"
ALL_MISSING = "all_missing_in_train"
CONSTANT = "constant_in_train"

REMOVE_COLUMN = "remove_column"
EXCLUDE_FEATURE = "exclude_feature"
ADD_MISSING_INDICATOR = "add_missing_indicator"
LIMIT_CARDINALITY = "limit_category_cardinality"
CONFIGURE_TARGET = "configure_target"

SAMPLE_ROWS = 10_000
PREVIEW_ROWS = 5
EXAMPLES = 3
DIALECT_BYTES = 128 * 1024
# -------------------------------------------------------------------------------------------


class PreparationError(ValueError):
    """A request that the engine refuses, with the reason as its message."""


@dataclass(frozen=True)
class PipelineConfig:
    """Knobs of one preparation run; bounds are checked on construction."""

    test_size: float = 0.2
    random_seed: int = 42
    stratify_classification: bool = True
    drop_duplicates: bool = True
    drop_constant_features: bool = True
    numeric_imputation: str = "median"
    categorical_imputation: str = "most_frequent"
    scaling: str = "standard"
    max_categories: int = 50
    schema_version: int = 1

    def __post_init__(self) -> None:
        _within("test_size", self.test_size, 0.1, 0.5)
        _within("random_seed", self.random_seed, 0, 2_147_483_647)
        _within("max_categories", self.max_categories, 2, 500)
        _one_of("numeric_imputation", self.numeric_imputation, ("mean", "median"))
        _one_of("categorical_imputation", self.categorical_imputation,
                ("most_frequent", "missing_category"))
        _one_of("scaling", self.scaling, ("none", "standard", "minmax"))

    def as_dict(self) -> dict[str, object]:
        return asdict(self)


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise PreparationError(f"{name} must lie in [{low}, {high}], got {value}")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise PreparationError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")
