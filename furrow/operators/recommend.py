"""Rule recommendations over a profile with roles: triggers, conflicts, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import column_id
from furrow.functions.types import STRING_NAMES
from furrow.session import materialize, small_table

# ---- fixed values: rule ids, thresholds, actions, severity, risk, confidence, default --------
TARGET_RULE = "BD-TARGET-001"
HIGH_MISSING = "BD-MISSING-001"
INDICATOR = "BD-MISSING-002"
CONSTANT = "BD-CONSTANT-001"
IDENTIFIER = "BD-ID-001"
CARDINALITY = "BD-CATEGORY-001"
HIGH_MISSING_RATE = 0.5
INDICATOR_RATE = 0.1
MANY_CATEGORIES = 50
RULES = {
    TARGET_RULE: (M.CONFIGURE_TARGET, "high", "high", 1.0, False),
    HIGH_MISSING: (M.REMOVE_COLUMN, "high", "high", 0.98, False),
    INDICATOR: (M.ADD_MISSING_INDICATOR, "low", "low", 0.95, True),
    CONSTANT: (M.REMOVE_COLUMN, "low", "low", 0.99, True),
    IDENTIFIER: (M.EXCLUDE_FEATURE, "medium", "low", 0.9, True),
    CARDINALITY: (M.LIMIT_CARDINALITY, "medium", "medium", 0.9, False),
}
PARAMETERS = {
    HIGH_MISSING: {"missing_rate_threshold": "0.5"},
    CARDINALITY: {"maximum_categories": "50"},
}
# -------------------------------------------------------------------------------------------

# The condition of each rule, as a reader sees it.
CONDITIONS = {
    TARGET_RULE: "count(role = target) <> 1",
    HIGH_MISSING: f"missing_rate >= {HIGH_MISSING_RATE}",
    INDICATOR: f"missing_rate >= {INDICATOR_RATE}",
    CONSTANT: "unique_count <= 1",
    IDENTIFIER: f"role = {M.ID}",
    CARDINALITY: f"unique_count > {MANY_CATEGORIES}",
}


def _triggers() -> dict[str, Column]:
    not_target = F.col("role") != M.TARGET
    rate, unique = F.col("missing_rate"), F.col("unique_count")
    return {
        HIGH_MISSING: (rate >= HIGH_MISSING_RATE) & not_target,
        INDICATOR: (rate >= INDICATOR_RATE) & not_target,
        CONSTANT: (unique <= 1) & not_target,
        IDENTIFIER: F.col("role") == M.ID,
        CARDINALITY: F.col("inferred_type").isin(*STRING_NAMES) & (unique > MANY_CATEGORIES),
    }


def _item(rule: str, column: Column, evidence: Column, suffix: Column) -> Column:
    action, severity, risk, confidence, default_on = RULES[rule]
    pairs = [F.lit(x) for kv in PARAMETERS.get(rule, {}).items() for x in kv]
    parameters = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        F.concat(F.lit(rule + ":"), suffix).alias("id"),
        F.lit(rule).alias("rule_id"),
        column.cast("string").alias("column"),
        F.lit(CONDITIONS[rule]).alias("condition"),
        evidence.alias("evidence"),
        F.lit(severity).alias("severity"),
        F.lit(risk).alias("risk"),
        F.lit(confidence).alias("confidence"),
        F.lit(action).alias("action"),
        parameters.alias("parameters"),
        F.lit(default_on).alias("enabled"),
    )


def recommendations(profile: DataFrame, task: str) -> DataFrame:
    """All recommendations with their conflicts, each default-enabled or not.

    A conflict joins a removal and a transformation of one column, and all recommendations of a
    column come out of one profile row, so conflicts are found inside that row without a join.
    """
    rate = F.format_string("missing rate %.1f%%", F.col("missing_rate") * 100)
    distinct = F.format_string("%d distinct values", F.col("unique_count"))
    evidence = {HIGH_MISSING: rate, INDICATOR: rate, CONSTANT: distinct, IDENTIFIER: distinct,
                CARDINALITY: distinct}
    items = F.array(*[
        F.when(when, _item(rule, F.col("column"), evidence[rule], column_id(F.col("column"))))
        for rule, when in _triggers().items()
    ])
    found = F.filter("_items", lambda r: r.isNotNull())
    removals = F.filter(found, lambda r: r["action"] == M.REMOVE_COLUMN)
    changes = F.filter(
        found, lambda r: ~r["action"].isin(M.REMOVE_COLUMN, M.EXCLUDE_FEATURE))
    by_column = (
        profile.select(items.alias("_items"))
        .select(F.inline(found), _ids(removals).alias("_removals"),
                _ids(changes).alias("_changes"))
        .withColumn("conflicts_with",
                    F.when(F.col("action") == M.REMOVE_COLUMN, F.col("_changes"))
                    .when(F.col("action") == M.EXCLUDE_FEATURE, _no_ids())
                    .otherwise(F.col("_removals")))
        .drop("_removals", "_changes")
    )
    if task not in M.SUPERVISED:
        return by_column
    targets = F.sum((F.col("role") == M.TARGET).cast("int"))
    whole = profile.agg(targets.alias("targets")).where(
        (F.col("targets") != 1) | F.col("targets").isNull())
    item = _item(TARGET_RULE, F.lit(None), F.format_string("%d target columns", F.col("targets")),
                 F.lit("project"))
    by_project = whole.select(F.inline(F.array(item))).withColumn("conflicts_with", _no_ids())
    return by_project.unionByName(by_column)


def _ids(items: Column) -> Column:
    return F.array_sort(F.transform(items, lambda r: r["id"]))


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def enable(recs: DataFrame, previous: Sequence[str] | None = None) -> DataFrame:
    """Keep the default selection on a first build, the earlier selection on later ones."""
    if previous is None:
        return recs
    spark = recs.sparkSession
    chosen = small_table(spark, [(i,) for i in dict.fromkeys(previous)], "id string")
    kept = recs.drop("enabled").join(
        F.broadcast(chosen.withColumn("enabled", F.lit(True))), "id", "left")
    return kept.withColumn("enabled", F.coalesce("enabled", F.lit(False)))


def selection_violations(recs: DataFrame, selected: DataFrame) -> DataFrame:
    """(problem, id) rows for a selection of ids: repeated, unknown, or in conflict."""
    # Read several times below; stored once instead of derived from the profile each time.
    recs = materialize(recs.select("id", "conflicts_with"), "recommendations")
    counted = selected.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    repeated = counted.where("times > 1").select(F.lit("duplicate").alias("problem"), "id")
    unknown = counted.join(recs.select("id"), "id", "left_anti").select(
        F.lit("unknown").alias("problem"), "id")
    pairs = recs.select("id", F.explode("conflicts_with").alias("other"))
    clashing = (
        pairs.join(counted.select("id"), "id", "left_semi")
        .join(counted.select(F.col("id").alias("other")), "other", "left_semi")
        .select(F.lit("conflict").alias("problem"), "id").distinct()
    )
    return repeated.unionByName(unknown).unionByName(clashing)


def select_recommendations(recs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Recommendations with exactly `ids` enabled, or an error that says why not."""
    chosen = small_table(recs.sparkSession, [(i,) for i in ids], "id string")
    problems = selection_violations(recs, chosen).collect()
    if problems:
        listed = ", ".join(sorted(f"{p['problem']}: {p['id']}" for p in problems))
        raise M.PreparationError(f"recommendations cannot be enabled ({listed})")
    return enable(recs, ids)
