"""Six-dimension quality score over a column profile with roles.

The input has one row per table column, so everything here is small; each function is one
aggregate (scores) or one projection (deductions), and the profile is never computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.types import STRING_NAMES, UNSTABLE_NAMES

# ---- fixed values: rule ids, points and limits ---------------------------------------------
COMPLETENESS, VALIDITY, CONSISTENCY = "completeness", "validity", "consistency"
UNIQUENESS, STRUCTURE, READINESS = "uniqueness", "structure_usability", "task_readiness"
DIMENSIONS = (COMPLETENESS, VALIDITY, CONSISTENCY, UNIQUENESS, STRUCTURE, READINESS)
RULE_MISSING = "BD-Q-COMP-001"
RULE_TYPE = "BD-Q-VALID-001"
RULE_MIXED = "BD-Q-CONS-001"
RULE_CONSTANT = "BD-Q-UNIQ-001"
RULE_ROLE = "BD-Q-STRUCT-001"
RULE_CARDINALITY = "BD-Q-STRUCT-002"
RULE_TARGET = "BD-Q-TASK-001"
RULE_NO_FEATURE = "BD-Q-TASK-002"
POINTS = {
    RULE_TYPE: 10, RULE_MIXED: 5, RULE_CONSTANT: 15, RULE_ROLE: 5, RULE_CARDINALITY: 8,
    RULE_TARGET: 35, RULE_NO_FEATURE: 50,
}
CONSISTENCY_LIMIT = 30
STRUCTURE_LIMIT = 45
MANY_CATEGORIES = 50
# -------------------------------------------------------------------------------------------


def _applies() -> dict[str, Column]:
    """When each column-level rule deducts."""
    missing, unique = F.col("missing_count"), F.col("unique_count")
    text = F.col("inferred_type").isin(*STRING_NAMES)
    return {
        RULE_MISSING: missing > 0,
        RULE_TYPE: F.col("inferred_type").isin(*UNSTABLE_NAMES),
        RULE_MIXED: (missing > 0) & (unique > 1),
        RULE_CONSTANT: unique <= 1,
        RULE_ROLE: F.col("role").isin(M.ID, M.TEXT),
        RULE_CARDINALITY: text & (unique > MANY_CATEGORIES),
    }


def _points(rule: str) -> Column:
    if rule == RULE_MISSING:
        return F.greatest(F.lit(1), F.bround(F.col("missing_rate") * 100).cast("int"))
    return F.lit(POINTS[rule])


def _facts(profile: DataFrame) -> DataFrame:
    """Everything the six scores need, in one row."""
    hits = {rule: F.sum(F.coalesce(when, F.lit(False)).cast("int"))
            for rule, when in _applies().items()}
    unusable = F.col("role").isin(M.IGNORE, M.ID, M.TEXT)
    return profile.agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum("rows").alias("cells"),
        F.sum("missing_count").alias("missing"),
        F.sum((F.col("role") == M.TARGET).cast("int")).alias("targets"),
        F.sum(unusable.cast("int")).alias("unusable"),
        *[n.alias(rule) for rule, n in hits.items()],
    )


def _lost(rule: str) -> Column:
    return F.col(f"`{rule}`") * POINTS[rule]


def _scores(task: str) -> dict[str, Column]:
    no_target, no_feature = _project_rules(task)
    return {
        COMPLETENESS: F.when(
            F.col("cells") > 0, F.bround(100 * (1 - F.col("missing") / F.col("cells")))
        ).otherwise(0),
        VALIDITY: 100 - _lost(RULE_TYPE),
        CONSISTENCY: 100 - F.least(F.lit(CONSISTENCY_LIMIT), _lost(RULE_MIXED)),
        UNIQUENESS: 100 - _lost(RULE_CONSTANT),
        STRUCTURE: 100 - F.least(F.lit(STRUCTURE_LIMIT),
                                 _lost(RULE_ROLE) + _lost(RULE_CARDINALITY)),
        READINESS: 100 - F.when(no_target, POINTS[RULE_TARGET]).otherwise(0)
        - F.when(no_feature, POINTS[RULE_NO_FEATURE]).otherwise(0),
    }


def _project_rules(task: str) -> tuple[Column, Column]:
    no_target = F.col("targets") != 1 if task in M.SUPERVISED else F.lit(False)
    no_feature = (F.col("columns") > 0) & (F.col("unusable") == F.col("columns"))
    return no_target, no_feature


def quality_dimensions(profile: DataFrame, task: str) -> DataFrame:
    """(dimension, score): six rows of whole numbers between 0 and 100."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("dimension"),
                 F.greatest(F.lit(0), score).cast("int").alias("score"))
        for name, score in _scores(task).items()
    ])
    return _facts(profile).select(F.inline(rows))


def quality_dimension(profile: DataFrame, task: str, name: str) -> DataFrame:
    return quality_dimensions(profile, task).where(F.col("dimension") == name)


def quality_report(profile: DataFrame, task: str) -> DataFrame:
    """The six dimensions and `total`, their mean rounded half to even."""
    scores = {n: F.greatest(F.lit(0), s).cast("int") for n, s in _scores(task).items()}
    wide = _facts(profile).select(*[s.alias(n) for n, s in scores.items()])
    mean = sum((F.col(n) for n in DIMENSIONS), F.lit(0)) / len(DIMENSIONS)
    rows = F.array(
        *[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("score")) for n in DIMENSIONS],
        F.struct(F.lit("total").alias("dimension"), F.bround(mean).cast("int").alias("score")),
    )
    return wide.select(F.inline(rows))


def quality_deductions(profile: DataFrame, task: str) -> DataFrame:
    """Every deduction: dimension, rule, column (null for the project), points, reason, evidence."""
    missing, unique = F.col("missing_count"), F.col("unique_count")
    wording = {
        RULE_MISSING: (COMPLETENESS, "missing_count > 0", F.format_string(
            "%d rows missing, %.1f%%", missing, F.col("missing_rate") * 100)),
        RULE_TYPE: (VALIDITY, "inferred_type in " + ", ".join(UNSTABLE_NAMES), F.format_string(
            "inferred type %s", F.col("inferred_type"))),
        RULE_MIXED: (CONSISTENCY, "missing_count > 0 and unique_count > 1", F.format_string(
            "%d distinct values, %d missing", unique, missing)),
        RULE_CONSTANT: (UNIQUENESS, "unique_count <= 1", F.format_string(
            "%d distinct values", unique)),
        RULE_ROLE: (STRUCTURE, f"role in {M.ID}, {M.TEXT}", F.format_string(
            "role %s", F.col("role"))),
        RULE_CARDINALITY: (STRUCTURE, f"unique_count > {MANY_CATEGORIES}", F.format_string(
            "%d distinct values", unique)),
    }
    applies = _applies()
    found = F.array(*[
        F.when(applies[rule], _deduction(dim, rule, F.col("column"), _points(rule), reason, proof))
        for rule, (dim, reason, proof) in wording.items()
    ])
    by_column = profile.select(F.inline(F.filter(found, lambda d: d.isNotNull())))
    no_target, no_feature = _project_rules(task)
    nothing = F.lit(None).cast("string")
    whole = F.array(
        F.when(no_target, _deduction(
            READINESS, RULE_TARGET, nothing, F.lit(POINTS[RULE_TARGET]),
            "count(role = target) <> 1",
            F.format_string("%d target columns", F.col("targets")))),
        F.when(no_feature, _deduction(
            READINESS, RULE_NO_FEATURE, nothing, F.lit(POINTS[RULE_NO_FEATURE]),
            "count(feature) = 0", F.lit("all are id, text or ignored"))),
    )
    by_project = _facts(profile).select(F.inline(F.filter(whole, lambda d: d.isNotNull())))
    return by_column.unionByName(by_project)


def _deduction(dimension: str, rule: str, column: Column, points: Column, reason: str,
               evidence: Column) -> Column:
    return F.struct(
        F.lit(dimension).alias("dimension"), F.lit(rule).alias("rule_id"),
        column.alias("column"), points.cast("int").alias("points"),
        F.lit(reason).alias("reason"), evidence.alias("evidence"),
    )
