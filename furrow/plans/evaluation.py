"""The evaluation run: baseline against full scheme, or exports only when it is off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import evaluate as E
from furrow.plans.pipeline import ROW, PreparationRun, with_row_token

# ---- fixed values ----
OFF, QUICK = "off", "quick"
# ----------------------


def evaluate_run(run: PreparationRun, mode: str = QUICK,
                 solver: str = E.NORMAL) -> DataFrame | None:
    """(scheme, metric, value) of both schemes on the run's own split; None when off."""
    if mode == OFF:
        return None
    if mode != QUICK:
        raise M.PreparationError(f"unknown evaluation mode {mode!r}")
    if run.task == M.CLEANING:
        raise M.PreparationError("a cleaning run has no model evaluation; switch it off")
    for part in ("train", "test"):
        # Both schemes have to be scored on the same rows with the same targets.
        raw = with_row_token(run.frames[f"raw_{part}"], run.key)
        off = E.same_split_check(raw, run.tokened[part], [ROW, run.target])
        if off.head() is not None:
            raise M.PreparationError(f"the {part} parts of the two schemes differ")
    rows = run.split.n - run.split.n_test
    base_train, base_test = E.baseline_features(
        run.raw_train, run.raw_test, run.roles, run.features, run.target, run.state)
    full = [E.complete_features(run.tokened[p], run.outputs, run.target)
            for p in ("train", "test")]
    baseline = E.score_scheme(base_train, base_test, run.task, rows, solver)
    complete = E.score_scheme(full[0], full[1], run.task, rows, solver)
    return baseline.select(F.lit(E.BASELINE).alias("scheme"), "metric", "value").unionByName(
        complete.select(F.lit(E.COMPLETE).alias("scheme"), "metric", "value"))


def compare_schemes(run: PreparationRun, solver: str = E.NORMAL) -> DataFrame:
    """(metric, baseline, complete, delta) of a supervised run; `solver` as in `fit_ridge`."""
    return E.scheme_comparison(evaluate_run(run, solver=solver))
