"""Exact quantiles against sorting, and the actions on outliers."""

import random

import numpy as np
import pytest

from furrow import model as M
from furrow.operators import outliers

SHARES = (0.0, 0.013, 0.25, 0.5, 0.75, 0.9, 1.0)


@pytest.mark.parametrize("buckets", [2, 512])
def test_quantiles_against_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(outliers, "BUCKETS", buckets)
    draw = random.Random(8)
    kinds = [lambda: draw.gauss(0, 1), lambda: float(draw.randrange(4)),
             lambda: draw.choice([-1, 1]) * 10.0 ** draw.randrange(-300, 300),
             lambda: draw.choice([0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]), lambda: 7.5]
    size = 40 if buckets == 2 else 301
    columns = [[draw.choice([None, kind(), kind()]) for _ in range(size)] for kind in kinds]
    df = spark.createDataFrame(list(zip(*columns)), "a double, b double, `c.c` double, d double, e double")
    found = outliers.exact_quantiles(df.repartition(3), df.columns, SHARES)
    for name, cells in zip(df.columns, columns):
        values = sorted(v for v in cells if v is not None)
        for share, got in zip(SHARES, found[name]):
            place = share * (len(values) - 1)
            low, high = values[int(np.floor(place))], values[int(np.ceil(place))]
            want = low if low == high else low * (1 - place % 1) + high * (place % 1)
            assert got == want, (name, share)


def test_quantiles_of_other_cells(spark):
    df = spark.createDataFrame([("1", float("nan"), None, 2**53 - 1), ("x", float("inf"), None, 3),
                                ("4", 2.0, None, 3)], "a string, b double, c int, d long")
    found = outliers.exact_quantiles(df, df.columns, [0.5])
    assert found == {"a": [2.5], "b": [2.0], "c": [None], "d": [3.0]}
    assert outliers.exact_quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}
    with pytest.raises(M.PreparationError):
        outliers.exact_quantiles(df, ["a"], [1.5])


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(k, float(k), str(k)) for k in range(1, 10)] + [(10, 100.0, "x"), (11, None, None)]
    return spark.createDataFrame(rows, "id long, price double, text string")


@pytest.fixture(scope="module")
def state(prices):
    # Of 1 to 9: quartiles 3 and 7, fences -3 and 13.
    fitted = outliers.fit_outliers(prices.where("id < 10"), ["price", "text"])
    again = outliers.OutlierState.from_json(fitted.to_json())
    assert again == fitted and fitted.quartiles == {"price": [3.0, 7.0], "text": [3.0, 7.0]}
    assert fitted.fences("price") == (-3.0, 13.0)
    return again


def cells(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("id").collect()][-2:]


def test_actions(prices, state):
    def act(action, **more):
        return outliers.treat_outliers(prices, state, {"price": action, **more})

    assert act("keep").collect() == prices.collect()
    assert cells(act("flag"), "price", "price__outlier") == [(100.0, 1), (None, 0)]
    assert cells(act("clip", text="clip"), "price", "text") == [(13.0, None), (None, None)]
    assert cells(act("null"), "price", "text") == [(None, "x"), (None, None)]
    assert [r.id for r in act("drop", text="flag").orderBy("id").collect()] == [*range(1, 10), 11]
    assert [tuple(r)[-2:] for r in outliers.outlier_report(prices, state).collect()] == [(1, 1), (0, 0)]


def test_actions_that_cannot_be(prices, state):
    for actions in ({"price": "remove"}, {"gone": "clip"}):
        with pytest.raises(M.PreparationError):
            outliers.treat_outliers(prices, state, actions)
    flagged = outliers.treat_outliers(prices, state, {"price": "flag"})
    with pytest.raises(M.PreparationError, match="flagged already"):
        outliers.treat_outliers(flagged, state, {"price": "flag"})
    none = outliers.fit_outliers(prices.where("false"), ["price"])
    assert none.quartiles == {} and outliers.outlier_report(prices, none).collect() == []
    assert outliers.treat_outliers(prices, none, dict.fromkeys(
        ["price", "text"], "clip")).where("price = 100").count() == 1
