"""Yeo-Johnson exponents against a dense search, and the saved state."""

import math

import numpy as np
import pytest

from furrow import model as M
from furrow.operators import power
from furrow.operators.fit import numeric_facts

DRAW = np.random.default_rng(4)
COLUMNS = {"wide": np.exp(DRAW.standard_normal(300) * 2 + 8), "both": DRAW.standard_normal(300) ** 3,
           "negative": -DRAW.gamma(2, 3, 300), "far": 1e5 + DRAW.gamma(2, 100, 300)}


@pytest.fixture(scope="module")
def table(spark):
    rows = [tuple(map(float, r)) for r in np.column_stack(list(COLUMNS.values()))]
    holes = [(None, None, float("nan"), float("inf"))]
    return spark.createDataFrame(rows + holes, ", ".join(f"{c} double" for c in COLUMNS))


@pytest.fixture(scope="module")
def state(table):
    return power.fit_yeo_johnson(table, list(COLUMNS))


def likelihood(x, e):
    logs = np.log1p(np.abs(x.astype(np.longdouble)))

    def size(p):
        return np.expm1(p * logs) / p if p else logs

    y = np.where(x >= 0, size(e), -size(2 - e))
    return float(-len(x) / 2 * np.log(y.var()) + (e - 1) * (np.sign(x) * logs).sum())


def test_likelihoods(table):
    grid = [-2.0, 0.0, 0.5, 2.0, 3.0]
    facts = {c: {"low": float(x.min()), "high": float(x.max())} for c, x in COLUMNS.items()}
    for r in power.log_likelihoods(table, dict.fromkeys(COLUMNS, grid), facts).collect():
        # The wide numbers of the dense version still lose digits far from zero.
        assert r.log_likelihood == pytest.approx(
            likelihood(COLUMNS[r.column], r.exponent), rel=1e-8), r


def test_exponents_against_search(state):
    for c in ("wide", "both", "negative"):
        low, high = power.LOW, power.HIGH
        for _ in range(80):
            one, two = low + (high - low) / 3, high - (high - low) / 3
            if likelihood(COLUMNS[c], one) < likelihood(COLUMNS[c], two):
                low = one
            else:
                high = two
        assert state.exponents[c] == pytest.approx(low, abs=1e-4)


def test_standardized_rows(table, state):
    again = power.PowerState.from_json(state.to_json())
    assert again == state
    rows = power.apply_yeo_johnson(table, again).collect()
    assert rows[-1] == (None,) * 4
    for i, (c, x) in enumerate(COLUMNS.items()):
        y = np.array([r[i] for r in rows[:-1]])
        assert (y.mean(), y.std()) == pytest.approx((0, 1), abs=1e-7)
        assert (np.argsort(y) == np.argsort(x)).all(), c


def test_both_forms_agree(spark, table, state):
    """The form without the constant is the formula up to scale, for values of new sign as well."""
    new = spark.createDataFrame([(v,) * 4 for v in (-40.0, -1.0, 0.0, 2.0, 700.0)], table.schema)
    plain = np.array(power.apply_yeo_johnson(new, state, False).collect())
    scaled = np.array(power.apply_yeo_johnson(new, state).collect())
    for i, c in enumerate(COLUMNS):
        if c != "far":
            a, b = np.polyfit(plain[:, i], scaled[:, i], 1)
            assert a > 0 and scaled[:, i] == pytest.approx(a * plain[:, i] + b, rel=1e-6), c
    for value, e in ((-40.0, 0.3), (700.0, 0.0), (-1.0, 2.0)):
        x = spark.createDataFrame([(value,)], "x double")
        found = x.select(power.yeo_johnson(x.x, e)).head()[0]
        p = e if value >= 0 else 2 - e
        size = math.expm1(p * math.log1p(abs(value))) / p if p else math.log1p(abs(value))
        assert found == pytest.approx(math.copysign(size, value))


def test_columns_without_spread(spark):
    df = spark.createDataFrame([(5.0, None, "1"), (5.0, None, "x"), (5.0, None, "3")],
                               "same double, none double, text string")
    state = power.fit_yeo_johnson(df, df.columns)
    assert state.exponents["same"] == state.exponents["none"] == 1.0
    rows = power.apply_yeo_johnson(df, state).collect()
    assert [r.same for r in rows] == [0, 0, 0] and [r.none for r in rows] == [None] * 3
    assert [r.text for r in rows] == [pytest.approx(-1), None, pytest.approx(1)]
    empty = power.fit_yeo_johnson(df.where("false"), df.columns)
    assert set(empty.exponents.values()) == {1.0}
    assert numeric_facts(df, ["text"], median=False)["text"]["rejected"] == 1
    with pytest.raises(M.PreparationError):
        power.fit_yeo_johnson(df, ["same"], low=1.0, high=1.0)


def test_rows_are_not_multiplied(spark):
    """A pass works on columns as arrays, in tasks of any number of rows, not on a row per exponent."""
    draw = np.random.default_rng(1)
    x = np.concatenate([1e6 + draw.random(400), [1e6] * 30])
    df = spark.createDataFrame([(float(v), 3.0, float(v) - 1e6 - 0.5) for v in x],
                               "far double, same double, both double").repartition(7)
    df = df.unionAll(spark.createDataFrame([(None, None, float("nan"))], df.schema))
    facts = numeric_facts(df, df.columns, median=False)
    found = power.log_likelihoods(df, dict.fromkeys(df.columns, [-4.0, 0.0, 2.0]), facts)
    assert "explode(" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.column, r.exponent): r.log_likelihood for r in found.collect()}
    assert len(rows) == 9 and {rows["same", e] for e in (-4.0, 0.0, 2.0)} == {None}
    for name, values in (("far", x), ("both", x - 1e6 - 0.5)):
        for e in (-4.0, 0.0, 2.0):
            if (name, e) != ("far", -4.0):
                assert rows[name, e] == pytest.approx(likelihood(values, e), rel=1e-6), (name, e)
    assert power.log_likelihoods(df.where("false"), {"far": [1.0]}, facts).count() == 0
