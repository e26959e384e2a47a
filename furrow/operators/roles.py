"""Inferring what each column is for, and checking the roles a user confirms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.types import NESTED_NAMES, NUMERIC_PREFIXES
from furrow.session import small_table

# ---- fixed values -------------------------------------------------------------------------
ID_NAME = r"(?i)(^id$|_id$|id_|编号|代码|编码|code|key)"
FEW_SHARE = 0.05
FEW_VALUES = 20
ID_SHARE = 0.98
TEXT_SHARE = 0.5
TEXT_LENGTH = 20
# -------------------------------------------------------------------------------------------


def infer_roles(profile: DataFrame) -> DataFrame:
    """The profile with a `role` per column; a projection, so it adds no shuffle."""
    kind, unique = F.col("inferred_type"), F.col("unique_count")
    share = F.when(F.col("rows") > 0, unique / F.col("rows")).otherwise(F.lit(0.0))
    texts = F.col("examples")
    total = F.aggregate(texts, F.lit(0), lambda acc, x: acc + F.length(x))
    mean_length = F.when(F.size(texts) > 0, total / F.size(texts)).otherwise(F.lit(0.0))
    numeric = F.lit(False)
    for prefix in NUMERIC_PREFIXES:
        numeric = numeric | kind.startswith(prefix)
    few = (share <= FEW_SHARE) | (unique <= FEW_VALUES)
    role = (
        F.when(kind.contains("Boolean"), M.BOOLEAN)
        .when(kind.contains("Date"), M.DATETIME)
        .when(numeric & few, M.DISCRETE_NUMERIC)
        .when(numeric, M.CONTINUOUS_NUMERIC)
        .when(kind.isin(*NESTED_NAMES), M.IGNORE)
        .when((share >= ID_SHARE) & F.col("column").rlike(ID_NAME), M.ID)
        .when((share >= TEXT_SHARE) & (mean_length >= TEXT_LENGTH), M.TEXT)
        .otherwise(M.NOMINAL_CATEGORY)
    )
    return profile.withColumn("role", role)


def with_roles(profile: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """The profile with confirmed roles in place of inferred ones."""
    given = small_table(profile.sparkSession, list(roles.items()), "column string, role string")
    return profile.join(F.broadcast(given), "column")


def role_violations(columns: DataFrame, overrides: DataFrame, task: str) -> DataFrame:
    """(problem, subject) rows for a role assignment; none means that it may be saved.

    `columns` has a `column` per table column, `overrides` (column, role) as entered. Both hold
    one row per table column.
    """
    given = overrides.groupBy("column").agg(F.count(F.lit(1)).alias("times"))
    known = columns.select("column", F.lit(True).alias("known"))
    matched = known.join(given, "column", "full_outer")
    problem = (
        F.when(F.col("known").isNull(), "unknown_column")
        .when(F.col("times").isNull(), "missing_column")
        .when(F.col("times") > 1, "duplicate_column")
    )
    by_column = matched.select(problem.alias("problem"), F.col("column").alias("subject"))
    bad_role = overrides.where(~F.col("role").isin(*M.ROLES) | F.col("role").isNull()).select(
        F.lit("unknown_role").alias("problem"), F.col("column").alias("subject"))
    targets = F.coalesce(F.sum((F.col("role") == M.TARGET).cast("bigint")), F.lit(0))
    count = overrides.agg(targets.alias("targets"))
    wrong = F.col("targets") != 1 if task in M.SUPERVISED else F.col("targets") != 0
    by_target = count.where(wrong).select(
        F.lit("target_count").alias("problem"), F.col("targets").cast("string").alias("subject"))
    return by_column.where("problem is not null").unionByName(bad_role).unionByName(by_target)


def confirm_roles(profile: DataFrame, overrides: Sequence[tuple[str, str]],
                  task: str) -> DataFrame:
    """The profile under the confirmed roles, or an error that lists what is wrong."""
    spark = profile.sparkSession
    given = small_table(spark, list(overrides), "column string, role string")
    problems = role_violations(profile.select("column"), given, task).collect()
    if problems:
        listed = ", ".join(sorted(f"{p['problem']}: {p['subject']}" for p in problems))
        raise M.PreparationError(f"roles do not fit the table ({listed})")
    return with_roles(profile, dict(overrides))
