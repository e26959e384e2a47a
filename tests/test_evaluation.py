import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import evaluate as E
from furrow.operators import metrics
from furrow.plans import evaluation
from furrow.plans import pipeline as P
from furrow.plans.pipeline import numeric_target

ROLES = {"row_id": "id", "amount": "continuous_numeric", "segment": "nominal_category",
         "target": "target"}
CONFIG = M.PipelineConfig(random_seed=23)


def frame(spark, target, kind):
    rows = [(f"R{i:03d}", None if i in (3, 14) else 1.5 * i, f"group-{i % 4}", target(i))
            for i in range(30)]
    return spark.createDataFrame(
        rows, f"row_id string, amount double, segment string, target {kind}")


@pytest.fixture(scope="module")
def classified(spark):
    df = frame(spark, lambda i: "yes" if i % 2 else "no", "string")
    return P.run_supervised(df, ROLES, M.CLASSIFICATION, CONFIG, key=["row_id"])


@pytest.fixture(scope="module")
def regressed(spark):
    df = frame(spark, lambda i: 2.25 * i + 1, "double")
    return P.run_supervised(df, ROLES, M.REGRESSION, CONFIG, key=["row_id"])


def test_classification_schemes(classified):
    assert (classified.train.count(), classified.test.count()) == (24, 6)
    scores = evaluation.compare_schemes(classified).collect()
    assert {r["metric"] for r in scores} == {"accuracy", "balanced_accuracy", "f1_weighted"}
    assert all(0 <= r["baseline"] <= 1 and 0 <= r["complete"] <= 1 for r in scores)


def test_regression_schemes(regressed):
    scores = {r["metric"]: r for r in evaluation.compare_schemes(regressed).collect()}
    assert set(scores) == {"mae", "rmse", "r2"}
    train, test = regressed.raw_train.collect(), regressed.raw_test.collect()
    median = np.median([r["amount"] for r in train if r["amount"] is not None])

    def matrix(rows):
        return np.array([[median if r["amount"] is None else r["amount"],
                          *(r["segment"] == f"group-{g}" for g in range(4))] for r in rows], float)

    y, z = (np.array([r["target"] for r in rows]) for rows in (train, test))
    x = matrix(train)
    centered = x - x.mean(0)
    w = np.linalg.solve(centered.T @ centered + np.eye(5), centered.T @ (y - y.mean()))
    error = z - (y.mean() + (matrix(test) - x.mean(0)) @ w)
    assert math.isclose(scores["mae"]["baseline"], np.abs(error).mean(), rel_tol=1e-9)
    assert math.isclose(scores["rmse"]["baseline"], math.sqrt((error ** 2).mean()), rel_tol=1e-9)
    assert math.isclose(scores["r2"]["baseline"],
                        1 - (error ** 2).sum() / ((z - z.mean()) ** 2).sum(), rel_tol=1e-9)


def test_modes(classified, spark):
    assert evaluation.evaluate_run(classified, evaluation.OFF) is None
    with pytest.raises(M.PreparationError, match="unknown evaluation mode"):
        evaluation.evaluate_run(classified, "slow")
    cleaned = P.run_cleaning(classified.raw_train, {**ROLES, "target": "nominal_category"})
    with pytest.raises(M.PreparationError, match="no model evaluation"):
        evaluation.evaluate_run(cleaned)
    assert evaluation.evaluate_run(cleaned, evaluation.OFF) is None


def test_same_split(classified, spark):
    raw = classified.raw_train
    assert E.same_split_check(raw, raw, ["row_id", "target"]).count() == 0
    swapped = raw.selectExpr("row_id", "case target when 'yes' then 'no' else 'yes' end as target")
    assert E.same_split_check(raw, swapped, ["row_id", "target"]).count() == 48


def test_other_rows_with_the_same_targets_are_refused(classified):
    other = classified.tokened["train"].withColumn(
        P.ROW, F.when(F.col(P.ROW) == F.lit(classified.tokened["train"].agg(
            F.min(P.ROW)).head()[0]), "another").otherwise(F.col(P.ROW)))
    changed = replace(classified, tokened={**classified.tokened, "train": other})
    with pytest.raises(M.PreparationError, match="train parts .* differ"):
        evaluation.evaluate_run(changed)


def vectors(spark, x, y):
    rows = [(*map(float, row), float(t)) for row, t in zip(x, y)]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, [*names, "_target"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, [1, 10, 0.2], (200, 3))
    y = x @ [2.0, -0.5, 7.0] + rng.normal(0, 1, 200)
    centered = x - x.mean(0)
    w = np.linalg.solve(centered.T @ centered + np.eye(3), centered.T @ (y - y.mean()))
    want = y.mean() + centered @ w
    data = vectors(spark, x, y)
    got = sorted(r["prediction"] for r in E.fit_ridge(data, data, 200).collect())
    assert np.allclose(got, sorted(want), rtol=1e-9)


def test_iterative_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(2)
    x, noise = rng.normal(0, 1, (150, 2)), rng.normal(0, 0.1, 150)
    y = x @ [1.0, 3.0] + noise
    centered = x - x.mean(0)
    w = np.linalg.solve(centered.T @ centered + np.eye(2), centered.T @ (y - y.mean()))
    data = vectors(spark, x, y)
    got = sorted(r["prediction"] for r in E.fit_ridge(data, data, 150, E.ITERATIVE).collect())
    assert np.allclose(got, sorted(y.mean() + centered @ w), atol=1e-4)


def test_one_feature_ridge_line(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, 100)
    y = 3 * x + rng.normal(0, 1, 100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    slope = ((x - x.mean()) * (y - y.mean())).sum() / (((x - x.mean()) ** 2).sum() + 1)
    got = sorted(r["prediction"] for r in E.ridge_line(df, df, "x", "y").collect())
    assert np.allclose(got, sorted(y.mean() + slope * (x - x.mean())))


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, 5], (300, 2))
    y = (x @ [1.0, -0.3] + rng.logistic(0, 1, 300) > 0.5).astype(float)
    a = np.c_[x, np.ones(300)]
    w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T * (p * (1 - p)) @ a + ridge, a.T @ (p - y) + ridge @ w)
    data = vectors(spark, x, y)
    scored = E.fit_logistic(data, data, 300)
    positive = scored.where("prediction = '1.0'").count()
    assert abs(positive - int((a @ w > 0).sum())) <= 1


def test_classification_metrics_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("b", "d")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    got = {r["metric"]: r["value"] for r in metrics.classification_metrics(df).collect()}
    f1 = {"a": 0.5, "b": 4 / 6, "c": 0.0}
    assert math.isclose(got["accuracy"], 0.5)
    assert math.isclose(got["balanced_accuracy"], (1 / 2 + 2 / 3 + 0) / 3)
    assert math.isclose(got["f1_weighted"], (2 * f1["a"] + 3 * f1["b"] + f1["c"]) / 6)


@pytest.mark.parametrize("prediction, r2", [(2.0, 1.0), (3.0, 0.0)])
def test_r2_of_a_constant_label(spark, prediction, r2):
    df = spark.createDataFrame([(2.0, prediction)] * 3, "label double, prediction double")
    got = {r["metric"]: r["value"] for r in metrics.regression_metrics(df).collect()}
    assert got["r2"] == r2 and got["mae"] == got["rmse"] == abs(prediction - 2.0)


def test_baseline_ignores_new_categories_and_fills_empty_numbers(spark):
    train = spark.createDataFrame([(None, "a", 1.0), (None, "b", 2.0), (None, None, 3.0)],
                                  "n double, c string, y double")
    test = spark.createDataFrame([(None, "z", 1.0)], "n double, c string, y double")
    roles = {"n": "continuous_numeric", "c": "nominal_category", "y": "target"}
    fitted = E.baseline_features(train, test, roles, ["n", "c"], "y")
    assert fitted[1].head()["features"].toArray().tolist() == [0.0, 0.0, 0.0]
    assert sorted(r["features"].toArray().tolist() for r in fitted[0].collect()) == [
        [0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]


def test_a_text_target_that_is_no_number_is_refused(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,)], "y string")
    with pytest.raises(M.PreparationError, match=r"y \(1\)"):
        numeric_target(df, "y")
    assert [r["y"] for r in numeric_target(df.where("y = '1.5'"), "y").collect()] == [1.5]
