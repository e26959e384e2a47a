import math

import numpy as np
import pytest
from conftest import SEGMENT_ROLES

from furrow import model as M
from furrow.operators import fit as T
from furrow.operators import transform as X
from furrow.plans import pipeline as P

CONFIG = M.PipelineConfig(random_seed=7, numeric_imputation="mean", scaling="none")


@pytest.fixture(scope="module")
def run(segments):
    return P.run_supervised(segments, SEGMENT_ROLES, M.CLASSIFICATION, CONFIG, key=["row_id"])


def test_split_first_fit_second(run, segments):
    assert (run.train.count(), run.test.count(), run.target_missing.count()) == (16, 4, 1)
    assert (run.raw_train.count(), run.raw_test.count()) == (16, 4) and run.stratified
    amount, segment = run.state.columns
    raw = [r["amount"] for r in run.raw_train.collect() if r["amount"] is not None]
    assert math.isclose(amount.fill_num, sum(raw) / len(raw))
    whole = [r["amount"] for r in segments.collect()
             if r["amount"] is not None and r["target"] is not None]
    assert not math.isclose(amount.fill_num, sum(whole) / len(whole))
    assert run.unknown_counts().collect()[0].asDict() == {"column": "segment", "unknown": 4}
    assert {r["segment__unknown"] for r in run.test.collect()} == {1}
    assert {r["segment__unknown"] for r in run.train.collect()} == {0}
    assert len(segment.categories) == 16 and segment.truncated is False
    tests = sorted(r["target"] for r in run.test.collect())
    assert tests == ["no", "no", "yes", "yes"]
    assert run.train.columns == [*run.outputs, "target"] and run.outputs[0] == "amount"


def test_same_seed_same_result(run, segments):
    again = P.run_supervised(segments.repartition(5), SEGMENT_ROLES, M.CLASSIFICATION, CONFIG,
                             key=["row_id"])
    assert again.state == run.state
    assert again.test.exceptAll(run.test).count() == 0


def test_test_rows_do_not_leak(run, segments, spark):
    from pyspark.sql import functions as F

    test_ids = [r["row_id"] for r in run.raw_test.collect()]
    poisoned = segments.withColumn(
        "amount", F.when(F.col("row_id").isin(test_ids), 10**9).otherwise(F.col("amount")))
    again = P.run_supervised(poisoned, SEGMENT_ROLES, M.CLASSIFICATION, CONFIG, key=["row_id"])
    assert again.state == run.state


def test_regression_is_scaled_by_train_range(priced_segments):
    config = M.PipelineConfig(random_seed=11, scaling="minmax")
    run = P.run_supervised(priced_segments, SEGMENT_ROLES, M.REGRESSION, config, key=["row_id"])
    assert not run.stratified and run.state.columns[0].scaling == "minmax"
    amounts = [r["amount"] for r in run.train.collect()]
    assert (min(amounts), max(amounts)) == (0.0, 1.0)


def cleaning_frame(spark):
    rows = [("A", 1, "上海", "首行"), ("B", None, "北京", "缺失"), ("B", None, "北京", "缺失"),
            ("C", 3, "上海", "正常"), ("D", 4, "深圳", "正常")]
    return spark.createDataFrame(rows, "record_id string, amount bigint, city string, note string")


CLEANING_ROLES = {"record_id": "id", "amount": "continuous_numeric", "city": "nominal_category",
                  "note": "ignore"}


def test_cleaning(spark):
    run = P.run_preparation(cleaning_frame(spark), CLEANING_ROLES, M.CLEANING,
                            M.PipelineConfig(scaling="none"),
                            [("amount", M.ADD_MISSING_INDICATOR)])
    rows = run.processed.collect()
    assert run.processed.columns == [
        "amount", "amount__is_missing", "city__category_000", "city__category_001",
        "city__category_002", "city__unknown"]
    assert sorted((r["amount"], r["amount__is_missing"]) for r in rows) == [
        (1.0, 0), (3.0, 0), (3.0, 1), (4.0, 0)]
    assert run.state.columns[1].categories == ["上海", "北京", "深圳"]
    with pytest.raises(M.PreparationError, match="no target"):
        P.run_cleaning(cleaning_frame(spark), {**CLEANING_ROLES, "note": "target"})


def test_refusals(spark, segments):
    with pytest.raises(M.PreparationError, match="not run"):
        P.run_preparation(segments, SEGMENT_ROLES, M.CLUSTERING_PREP)
    with pytest.raises(M.PreparationError, match="exactly one target"):
        P.run_supervised(segments, {**SEGMENT_ROLES, "target": "ignore"}, M.CLASSIFICATION)
    with pytest.raises(M.PreparationError, match="does not match"):
        P.run_supervised(segments.drop("amount"), SEGMENT_ROLES, M.CLASSIFICATION)
    with pytest.raises(M.PreparationError, match="no transformation"):
        T.select_features({"when": "datetime", "target": "target"})
    with pytest.raises(M.PreparationError, match="no feature columns"):
        T.select_features({"k": "id", "target": "target"})
    with pytest.raises(M.PreparationError, match="no numbers"):
        roles = {**SEGMENT_ROLES, "segment": "continuous_numeric"}
        P.run_supervised(segments, roles, M.CLASSIFICATION)
    with pytest.raises(M.PreparationError, match="cannot be split"):
        P.run_supervised(segments.limit(3), SEGMENT_ROLES, M.CLASSIFICATION)


def test_output_names_may_not_collide():
    state = T.FittedState([
        T.ColumnState("a", 0, "numeric", scaling="none", fill_num=0.0,
                      missing_indicator="a__is_missing"),
        T.ColumnState("a__is_missing", 1, "numeric", scaling="none", fill_num=0.0)])
    with pytest.raises(M.PreparationError, match="collide"):
        X.output_schema(state)
    with pytest.raises(M.PreparationError, match="no feature"):
        X.output_schema(T.FittedState([T.ColumnState("a", 0, "numeric", dropped="x")]))


def test_missing_indicator_outlives_its_column(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (None, "a")], "x double, c string")
    state = T.fit(df, {"x": "continuous_numeric", "c": "nominal_category"}, ["x", "c"], ["x"],
                  M.PipelineConfig())
    assert state.columns[0].dropped == M.CONSTANT
    assert X.output_names(state)[0] == "x__is_missing"


def numeric_state(spark, values, **knobs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return T.fit_numeric(df, ["x"], M.PipelineConfig(**knobs))["x"]


def test_numeric_states(spark):
    empty = numeric_state(spark, [None, None])
    assert empty.dropped == M.ALL_MISSING and empty.fill_num is None
    with pytest.raises(M.PreparationError, match="no value"):
        numeric_state(spark, [None], drop_constant_features=False)
    kept = numeric_state(spark, [2.0, None], drop_constant_features=False)
    assert (kept.center, kept.scale) == (2.0, 1.0)
    flat = numeric_state(spark, [2.0, 2.0], drop_constant_features=False, scaling="minmax")
    assert flat.scale == 1.0


@pytest.mark.parametrize("fill", ["mean", "median"])
def test_moments_after_filling_equal_those_of_filled_data(spark, fill):
    rng = np.random.default_rng(5)
    values = np.exp(rng.normal(9, 2, 400))
    cells = [None if i % 6 == 0 else float(v) for i, v in enumerate(values)]
    present = np.array([c for c in cells if c is not None])
    value = getattr(np, fill)(present)
    filled = np.array([value if c is None else c for c in cells])
    state = numeric_state(spark, cells, numeric_imputation=fill)
    assert math.isclose(state.fill_num, value, rel_tol=1e-12)
    assert math.isclose(state.center, filled.mean(), rel_tol=1e-12)
    assert math.isclose(state.scale, filled.std(), rel_tol=1e-12)


@pytest.mark.parametrize("final", [1, 3, 1000])
def test_bucketed_medians_are_exact(spark, final):
    rng = np.random.default_rng(11)
    n = 501
    columns = {
        "normal": rng.normal(0, 1, n), "tailed": np.exp(rng.normal(0, 60, n)),
        "signed": rng.choice([-1e300, -1.0, -1e-300, 0.0, 1e-300, 5.0], n),
        "apart": np.where(np.arange(n) % 2 == 0, 1e-9, 1e9), "flat": np.full(n, 3.25),
        "whole": rng.integers(-50, 50, n).astype(float), "tiny": rng.normal(0, 1e-310, n),
    }
    rows = [tuple(float(columns[c][i]) for c in columns) for i in range(n)]
    for size in (n, n - 1, 2, 1):
        df = spark.createDataFrame(rows[:size], [f"{c}" for c in columns])
        facts = T.numeric_facts(df, list(columns), median=False)
        found = T.exact_medians(df, list(columns), facts, final_values=final)
        for c, values in columns.items():
            assert found[c] == np.median(values[:size]), (c, size)


def test_median_is_the_same_for_any_cut_of_the_search(spark):
    df = spark.range(3000).selectExpr("case when id % 7 > 0 then pow(id, 1.5) end as x",
                                      "cast(id % 11 as string) as t")
    near = T.numeric_facts(df, ["x", "t"])
    far = T.numeric_facts(df, ["x", "t"], final_values=1)
    assert near == far
    values = [i ** 1.5 for i in range(3000) if i % 7]
    assert math.isclose(near["x"]["median"], np.median(values), rel_tol=1e-14)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
@pytest.mark.parametrize("imputation", ["mean", "median"])
def test_numbers_that_are_not_finite_are_refused(spark, odd, imputation):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(odd,)], "x double")
    assert T.numeric_facts(df, ["x"])["x"]["median"] == 24.5
    with pytest.raises(M.PreparationError, match=r"x \(1\)"):
        T.fit_numeric(df, ["x"], M.PipelineConfig(numeric_imputation=imputation))


def category_state(spark, values, **knobs):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return T.fit_categorical(df, ["c"], M.PipelineConfig(**knobs))["c"]


def test_category_states(spark):
    state = category_state(spark, ["b", " b　", "a", "a ", "c", None])
    assert state.fill_str == "a" and state.categories == ["a", "b", "c"]
    label = category_state(spark, ["b", "b", None, None, None],
                           categorical_imputation="missing_category")
    assert label.categories == ["__MISSING__", "b"] and label.fill_str == "__MISSING__"
    cut = category_state(spark, ["a", "a", "b", "b", "c"], max_categories=2)
    assert cut.categories == ["a", "b"] and cut.truncated
    nothing = category_state(spark, [None, None])
    assert nothing.dropped == M.CONSTANT and nothing.fill_str == "__MISSING__"
    kept = category_state(spark, [None, None], drop_constant_features=False)
    assert kept.categories == ["__MISSING__"]


def test_truncated_tail_is_unknown_in_train_too(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "c string")
    state = T.FittedState([category_state(spark, ["a", "a", "b", "b", "c"], max_categories=2)])
    rows = X.transform(df, state).collect()
    assert sum(r["c__unknown"] for r in rows) == 1
    assert X.transform(df, state).schema["c__unknown"].dataType.simpleString() == "tinyint"


def test_state_survives_json_and_tables(run, spark):
    assert T.FittedState.from_json(run.state.to_json()) == run.state
    assert T.FittedState.from_dataframe(run.state.to_dataframe(spark)) == run.state


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(float(i), f"v{i % 3}", "ab"[i % 2]) for i in range(20)],
                               "`a.b c` double, `x.y` string, t string")
    roles = {"a.b c": "continuous_numeric", "x.y": "nominal_category", "t": "target"}
    run = P.run_supervised(df, roles, M.CLASSIFICATION)
    assert run.train.columns[0] == "a.b c" and run.train.count() == 16
