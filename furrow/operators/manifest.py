"""Run records, their artifacts, and which results are out of date."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.plans.pipeline import PreparationRun
from furrow.session import small_table
from furrow.sources.tables import table_fingerprint

MANIFEST_SCHEMA = (
    "run_id string, project_id string, source_fingerprint string, created_at string, "
    "task string, config string, target_column string, feature_columns array<string>, "
    "output_feature_columns array<string>, applied_recommendation_ids array<string>, "
    "train_rows bigint, test_rows bigint, full_rows bigint, target_missing_rows bigint, "
    "stratified boolean, upstream string, learned string"
)


def upstream_fingerprint(roles: Mapping[str, str], enabled: list[str],
                         config: Mapping[str, object]) -> str:
    """Digest of everything that a result depends on beside the data."""
    payload = json.dumps([list(roles.items()), sorted(enabled), dict(config)], sort_keys=True)
    return hashlib.sha256(payload.encode()).hexdigest()


def run_manifest(run: PreparationRun, spark: SparkSession, project_id: str, run_id: str,
                 source_fingerprint: str, applied: list[str]) -> DataFrame:
    """One row that describes the run and its learned state."""
    if run.split is None:
        counts = {"processed": run.frames["processed"].count()}
    else:
        counts = {"train": run.split.n - run.split.n_test, "test": run.split.n_test,
                  "target_missing": run.frames["target_missing"].count()}
    row = (
        run_id, project_id, source_fingerprint, datetime.now(UTC).isoformat(), run.task,
        json.dumps(run.config.as_dict()), run.target, run.features, run.outputs, sorted(applied),
        counts.get("train", 0), counts.get("test", 0), counts.get("processed", 0),
        counts.get("target_missing", 0), run.stratified,
        upstream_fingerprint(run.roles, applied, run.config.as_dict()), run.state.to_json(),
    )
    return small_table(spark, [row], MANIFEST_SCHEMA).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))


def write_artifacts(run: PreparationRun, path: str, run_id: str) -> DataFrame:
    """Write every frame of a run under `path`; (run_id, name, path, rows, columns, fingerprint)."""
    parts = []
    for name, df in run.frames.items():
        target = f"{path}/{name}"
        df.write.mode("overwrite").parquet(target)
        stored = df.sparkSession.read.parquet(target)
        parts.append(table_fingerprint(stored).select(
            F.lit(run_id).alias("run_id"), F.lit(name).alias("name"), F.lit(target).alias("path"),
            "rows", F.lit(len(df.columns)).alias("columns"), "fingerprint"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest_run(runs: DataFrame, project: str = "project_id",
               created_at: str = "created_at", run_id: str = "run_id") -> DataFrame:
    """The newest run of each project, ties by run id.

    An aggregate, so a project with very many runs is reduced before the shuffle.
    """
    others = [c for c in runs.columns if c != project]
    newest = F.max_by(F.struct(*others), F.struct(created_at, run_id))
    return runs.groupBy(project).agg(newest.alias("_run")).select(
        project, *[F.col("_run")[c].alias(c) for c in others])


def stale_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Runs whose upstream differs from the project's current (project_id, upstream)."""
    now = current.select("project_id", F.col("upstream").alias("_now"))
    return runs.join(now, "project_id").where(~F.col("upstream").eqNullSafe(F.col("_now"))).drop(
        "_now")
