"""Correlations and principal components against dense computations."""

import numpy as np
import pytest

from furrow import model as M
from furrow.operators import gram


@pytest.fixture(scope="module")
def dense():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((400, 4)) @ draw.standard_normal((4, 25))
    x += 0.1 * draw.standard_normal(x.shape) + 1e6
    x[draw.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    x[:, 8] = x[:, 3] * -3
    return x


@pytest.fixture(scope="module")
def table(spark, dense):
    names = [f"c.{i}" for i in range(dense.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in dense]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)


def test_correlations_of_present_pairs(table, dense):
    found = {(r.a, r.b): r for r in gram.correlations(table, table.columns, block=6).collect()}
    assert len(found) == 25 * 24 // 2
    for i in range(25):
        for j in range(i + 1, 25):
            r = found[f"c.{i}", f"c.{j}"]
            both = np.isfinite(dense[:, i]) & np.isfinite(dense[:, j])
            assert r.rows == both.sum()
            if 7 in (i, j):
                assert r.r is None
            else:
                assert r.r == pytest.approx(np.corrcoef(dense[both][:, [i, j]].T)[0, 1], abs=1e-9)
    assert found["c.3", "c.8"].r == pytest.approx(-1)


def test_passes_do_not_change_sums(table, monkeypatch):
    one = sorted(map(tuple, gram.correlations(table, table.columns).collect()))
    monkeypatch.setattr(gram, "BLOCK_PAIRS_A_PASS", 2)
    many = sorted(map(tuple, gram.correlations(table, table.columns, block=9).collect()))
    assert [r[:3] for r in one] == [r[:3] for r in many]
    assert [r[3] or 0 for r in one] == pytest.approx([r[3] or 0 for r in many], abs=1e-12)


def test_high_correlations(table):
    found = [(r.a, r.b) for r in gram.high_correlations(table, ["c.3", "c.7", "c.8"]).collect()]
    assert found == [("c.3", "c.8")]
    with pytest.raises(M.PreparationError):
        gram.high_correlations(table, ["c.3"], 0.0)


@pytest.mark.parametrize("standardize", [True, False])
def test_components_against_dense(table, dense, standardize):
    fitted = gram.fit_components(table, table.columns, 3, standardize)
    assert fitted.rounds > 1
    filled = np.where(np.isfinite(dense), dense, np.nanmean(dense, axis=0))
    z = filled - filled.mean(axis=0)
    if standardize:
        z /= np.where(z.std(axis=0) > 1e-9, z.std(axis=0), 1.0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert fitted.variances == pytest.approx(values[::-1][:3], rel=1e-6)
    assert fitted.total_variance == pytest.approx(values.sum(), rel=1e-9)
    same = np.abs(np.array(fitted.loadings) @ vectors[:, ::-1][:, :3])
    assert same == pytest.approx(np.eye(3), abs=1e-6)
    assert fitted.loadings[0][7] == 0.0
    assert all(max(line, key=abs) > 0 for line in fitted.loadings)
    again = gram.Components.from_json(fitted.to_json())
    assert again == fitted
    rows = gram.project(table, again).select("`c.0`", "pc1", "pc2", "pc3").collect()
    scores = np.array([r[1:] for r in rows])
    assert scores.var(axis=0) == pytest.approx(fitted.variances, rel=1e-6)
    assert scores.mean(axis=0) == pytest.approx(0, abs=1e-8)


def test_text_numbers_and_other_cells(spark):
    df = spark.createDataFrame(
        [("1", 2.0), ("2", 4.0), ("3", 6.0), ("x", 1.0), ("4", float("nan")), (None, 3.0)],
        "a string, b double")
    r, = gram.correlations(df, ["a", "b"]).collect()
    assert (r.rows, r.r) == (3, pytest.approx(1.0))
    assert gram.correlations(df.where("false"), ["a", "b"]).collect() == []


def test_components_that_cannot_be(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None)], "a double, b double, c double")
    for columns, components in ((["a", "b"], 2), (["a", "b"], 3), (["b"], 1), (["c"], 1), ([], 1)):
        with pytest.raises(M.PreparationError):
            gram.fit_components(df, columns, components)
    fitted = gram.fit_components(df, ["a", "b"], 1)
    with pytest.raises(M.PreparationError, match="exist already"):
        gram.project(df.withColumnRenamed("c", "PC1"), fitted)
