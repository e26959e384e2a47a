"""Chained ridge models against a dense version, on planted linear tables and on edge cases."""

import numpy as np
import pytest

from furrow import model as M
from furrow.operators import chained as C

NAMES = ["a", "b", "c", "d"]


def planted(rows, seed=3, share=0.15, noise=0.0):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(50, 10, rows), rng.normal(-3, 2, rows)
    full = np.column_stack([u, 2 * u - v + 5, v, 3 * v + u]) + rng.normal(0, noise, (rows, 4))
    holes = rng.random(full.shape) < share
    holes[:, 2] = False
    return full, np.where(holes, np.nan, full)


def frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(
        rows, "id long, a double, b double, c double, d double").repartition(5)


def values(df):
    return np.array([[r[c] for c in NAMES] for r in sorted(df.collect(), key=lambda r: r["id"])])


def dense(x, rounds, penalty):
    """The same chain over a whole matrix, with least squares on stacked rows instead of products."""
    missing = np.isnan(x)
    mean, scale = np.nanmean(x, 0), np.nanstd(x, 0)
    start = np.where(missing, 0, (x - mean) / scale)
    order = sorted(range(x.shape[1]), key=lambda j: (not missing[:, j].any(), missing[:, j].sum(), j))
    done = []
    for _ in range(rounds):
        z = start.copy()
        for models in done:
            for j, (w, c) in zip(order, models):
                z[missing[:, j], j] = np.delete(z, j, 1)[missing[:, j]] @ w + c
        models = []
        for j in order:
            rows = np.delete(z, j, 1)[~missing[:, j]]
            y, middle = z[~missing[:, j], j], rows.mean(0)
            stacked = np.vstack([rows - middle, np.sqrt(penalty * len(rows)) * np.eye(rows.shape[1])])
            w = np.linalg.lstsq(stacked, np.r_[y - y.mean(), np.zeros(rows.shape[1])], rcond=None)[0]
            models.append((w, y.mean() - w @ middle))
        done.append(models)
    z = start.copy()
    for models in done:
        for j, (w, c) in zip(order, models):
            z[missing[:, j], j] = np.delete(z, j, 1)[missing[:, j]] @ w + c
    return z * scale + mean


@pytest.mark.parametrize("rounds", [1, 4])
def test_equals_dense_version(spark, rounds):
    _, x = planted(400, noise=1.0)
    df = frame(spark, x)
    state = C.fit_chained(df, NAMES, rounds=rounds, tolerance=0.0)
    assert len(state.rounds) == rounds and not state.converged
    again = C.ChainedState.from_json(state.to_json())
    got = values(C.impute_chained(df, again))
    assert np.allclose(got, dense(x, rounds, C.PENALTY), rtol=1e-8, atol=1e-8)
    assert np.array_equal(got[~np.isnan(x)], x[~np.isnan(x)])


def test_converges_on_a_planted_table(spark):
    full, x = planted(600)
    df = frame(spark, x)
    state = C.fit_chained(df, NAMES, rounds=60, tolerance=1e-5, penalty=1e-6)
    assert state.converged and state.changes[-1] <= 1e-5
    # One hole leaves three columns of a plane of two dimensions, so the value is determined.
    single = np.isnan(x).sum(1) == 1
    error = np.abs(values(C.impute_chained(df, state)) - full)[single]
    assert single.sum() > 100 and error.max() < 0.05


def test_only_training_rows_are_learned_from(spark):
    _, x = planted(200)
    state = C.fit_chained(frame(spark, x), NAMES)
    other = frame(spark, np.where(np.isnan(x), np.nan, x * 100))
    before = state.to_json()
    C.impute_chained(other, state).count()
    assert state.to_json() == before


def test_edges(spark):
    rows = [(1, "1.5", 2.0, 7.0, "x"), (2, "no", float("nan"), 7.0, "y"), (3, None, float("inf"), None, None),
            (3, None, float("inf"), None, None), (4, "3.5", 4.0, 7.0, "z"), (5, "2.5", None, 7.0, "z")]
    df = spark.createDataFrame(rows, "id long, a string, `b.c` double, k double, _filled string")
    state = C.fit_chained(df, ["a", "b.c", "k"])
    done = C.impute_chained(df, state)
    assert done.columns == df.columns
    got = sorted(done.collect(), key=lambda r: r["id"])
    assert [r["_filled"] for r in got] == ["x", "y", None, None, "z", "z"]
    assert [r["a"] for r in got][::4] == [1.5, 3.5]
    assert all(np.isfinite([r["a"], r["b.c"], r["k"]]).all() for r in got)
    # A constant column stays constant, and equal rows are filled alike.
    assert np.allclose([r["k"] for r in got], 7.0) and got[2] == got[3]
    assert abs(got[5]["b.c"] - 3.0) < 0.1
    assert C.impute_chained(df.where("id > 9"), state).count() == 0
    for frame_, columns, message in (
            (df.where("id > 9"), ["a", "b.c"], "no value"), (df, ["a"], "2 to"),
            (df, ["a", "a"], "twice")):
        with pytest.raises(M.PreparationError, match=message):
            C.fit_chained(frame_, columns)
    with pytest.raises(M.PreparationError, match="no such column"):
        C.impute_chained(df.drop("k"), state)
