"""The list of projects: order, search, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: labels under which a task is found, and states that count as active --------
TASK_LABELS = {
    "classification": "分类",
    "regression": "回归",
    "clustering_prep": "聚类预处理",
    "cleaning": "纯数据清洗",
}
ACTIVE = ("processing", "running")
# ---------------------------------------------------------------------------------------------


def catalog_list(projects: DataFrame) -> DataFrame:
    """Newest first."""
    return projects.orderBy(F.desc("created_at"), F.asc("id"))


def task_label(task: Column) -> Column:
    label = task
    for key, text in TASK_LABELS.items():
        label = F.when(task == key, text).otherwise(label)
    return label


def catalog_search(projects: DataFrame, query: str) -> DataFrame:
    """Projects whose name, file or task label contains the text, whatever its case."""
    wanted = query.strip().lower()
    if not wanted:
        return projects
    hit = F.lit(False)
    for text in (F.col("name"), F.col("source_filename"), task_label(F.col("task_type"))):
        hit = hit | F.lower(text).contains(wanted)
    return projects.where(hit)


def catalog_summary(projects: DataFrame) -> DataFrame:
    """(active, storage): running projects and the sum of their sources' sizes."""
    return projects.agg(
        F.coalesce(F.sum(F.col("status").isin(*ACTIVE).cast("bigint")), F.lit(0)).alias("active"),
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("storage"),
    )
