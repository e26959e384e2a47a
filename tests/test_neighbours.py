"""Imputation by neighbours against comparisons with all donors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import neighbours as N

NUMBERS, WORDS = ["a", "b", "c"], ["kind"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    found = []
    for k in range(1_500):
        a, b = draw.gauss(0, 3), draw.random()
        row = [a, b, a * 2 + b + draw.gauss(0, 0.1), "xyz"[int(b * 3)] + " "]
        found.append((k, *[v if draw.random() > 0.04 else None for v in row]))
    return found


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, kind string")


def brute(model, holes):
    """Per hole of a question the distances of all donors."""
    donors = model.donors.toPandas()
    c = model.coordinates
    n = len(c.numeric)
    y = donors[[f"y{i}" for i in range(n)]].to_numpy(float)
    words = donors[[f"y{n + j}" for j in range(len(c.categorical))]].to_numpy(object)
    found = {}
    for r in holes.collect():
        apart, has = np.zeros(len(donors)), np.ones(len(donors), bool)
        for i in range(len(c.columns)):
            if r[f"q{i}"] is None:
                continue
            if i < n:
                apart += ((y[:, i] - r[f"q{i}"]) / c.deviations[i]) ** 2
                has &= ~np.isnan(y[:, i])
            else:
                apart += (words[:, i - n] != r[f"q{i}"]).astype(float)
                has &= np.array([w is not None for w in words[:, i - n]])
        for target in range(len(c.columns)):
            if r[f"q{target}"] is None and r.pattern:
                own = has & ~donors[f"y{target}"].isna().to_numpy()
                found[(r.question, target)] = np.where(own, apart, np.inf)
    return found


@pytest.mark.parametrize("settings", [{}, {"bucket": 20, "large_bucket": 40, "tables": 12}])
def test_recall(df, settings):
    """Also in small buckets that are split often, which need more tables."""
    model = N.fit_neighbours(df, NUMBERS, WORDS, **settings)
    holes = N.holes_of(df, model)
    near = N.neighbours(model, holes).collect()
    distances = brute(model, holes)
    hits = asked = 0
    for key, all_of_them in distances.items():
        mine = [r.distance for r in near if (r.question, r.target) == key]
        limit = np.sort(all_of_them)[N.NEIGHBOURS - 1]
        hits += sum(d <= limit + 1e-9 for d in mine)
        asked += N.NEIGHBOURS
    assert len(distances) > 150 and hits / asked >= 0.9


def test_one_bucket_is_exact(df):
    few = df.where("id < 90")
    model = N.fit_neighbours(few, NUMBERS, WORDS, k=3, bucket=1_000)
    near = N.neighbours(model, N.holes_of(few, model)).collect()
    for key, all_of_them in brute(model, N.holes_of(few, model)).items():
        mine = sorted(r.distance for r in near if (r.question, r.target) == key)
        want = np.sort(all_of_them)[:3]
        assert mine == pytest.approx(want[np.isfinite(want)])


def test_filled_values(df, rows):
    model = N.fit_neighbours(df, NUMBERS, WORDS)
    filled = {r.id: r for r in N.impute(df, model).collect()}
    assert len(filled) == len(rows) and N.impute(df, model).columns == df.columns
    errors, right, holes = [], 0, 0
    for k, a, b, c, kind in rows:
        r = filled[k]
        assert None not in (r.a, r.b, r.c, r.kind)
        assert [x for x in (a, b, c) if x is not None] == [
            y for x, y in zip((a, b, c), (r.a, r.b, r.c)) if x is not None]
        if c is None and None not in (a, b):
            errors.append(abs(r.c - (2 * a + b)))
        if kind is None and b is not None:
            holes, right = holes + 1, right + (r.kind == "xyz"[int(b * 3)])
    assert np.mean(errors) < 0.5 and right / holes > 0.7


def test_copies_and_odd_values(spark):
    """Many equal rows are one donor and one question; NaN and infinity are holes."""
    nan, inf = float("nan"), float("inf")
    same = [(1.0, 2.0, 5.0, "u")] * 2_000 + [(1.0, 2.0, None, "u")] * 1_000
    odd = [(nan, 2.0, 7.0, "v"), (inf, 4.0, 7.0, None), (None, None, None, None), (9.0, 2.0, 6.0, "v")]
    df = spark.createDataFrame(same + odd, "a double, b double, c double, kind string")
    model = N.fit_neighbours(df, NUMBERS, WORDS, k=2, bucket=1)
    assert model.n_donors == 5
    assert N.holes_of(df, model).count() == 4
    filled = N.impute(df, model)
    assert filled.count() == 3_004
    assert filled.where("a IS NULL OR isnan(a) OR b IS NULL OR c IS NULL OR kind IS NULL").count() == 0


def test_nothing_to_learn_from(spark, df):
    empty = df.where("false")
    model = N.fit_neighbours(empty, NUMBERS, WORDS)
    assert [r.c for r in N.impute(df.where("c IS NULL").limit(2), model).collect()] == [None, None]
    assert N.impute(empty, N.fit_neighbours(df.limit(50), NUMBERS, WORDS)).count() == 0
    blank = df.withColumn("a", F.lit(None).cast("double"))
    model = N.fit_neighbours(blank, ["a", "b"])
    assert N.impute(blank, model).where("a IS NOT NULL").count() == 0
    with pytest.raises(M.PreparationError):
        N.fit_neighbours(df, [], [])


@pytest.mark.parametrize("settings", [{"bucket": 8}, {"bucket": 8, "large_bucket": 20, "tables": 1_000}])
def test_small_cells_are_exact(df, monkeypatch, settings):
    """Every cell that may hold a neighbour is visited, of a tree out of all donors or of a few."""
    monkeypatch.setattr(N, "SAMPLE", 10_000 if len(settings) == 1 else 200)
    model = N.fit_neighbours(df, NUMBERS, WORDS, **settings)
    cells = {r["cell"]: r["count"] for r in N._placed(model, model.donors, "y").groupBy(
        "cell").count().collect()}
    assert len(cells) > 70 and max(cells.values()) <= 40
    holes = N.holes_of(df, model)
    near = {}
    for r in N.neighbours(model, holes).collect():
        near.setdefault((r.question, r.target), []).append(r.distance)
    for key, distances in brute(model, holes).items():
        assert sorted(near[key]) == pytest.approx(np.sort(distances)[:N.NEIGHBOURS], abs=1e-9)


def test_few_donors_far_away(spark):
    """A question whose own cells hold no donor for its hole asks again in more cells."""
    rows = [(float(k), float(k % 7), None) for k in range(600)]
    rows += [(1e4 + k, 1.0, f"w{k}") for k in range(9)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    for tables in (20, 1_000):
        model = N.fit_neighbours(df, ["a", "b"], ["c"], k=3, bucket=4, tables=tables)
        near = N.neighbours(model, N.holes_of(df, model)).collect()
        assert len(near) == 600 * 3
    assert {r.word for r in near} == {"w0", "w1", "w2"}
    filled = N.impute(df, model)
    assert filled.count() == 609 and filled.where("c NOT IN ('w0', 'w1', 'w2')").count() == 6


def test_index_holds_a_donor_once(df):
    """One set of cells serves all patterns of holes; no row per donor, pattern and table is stored."""
    stored, kept = [], N.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(N, "materialize",
                      lambda rows, label: stored.append(kept(rows, label)) or stored[-1])
        model = N.fit_neighbours(df, NUMBERS, WORDS)
        holes = N.holes_of(df, model)
        N.neighbours(model, holes).count()
        assert max(t.count() for t in stored) <= max(model.n_donors, 4 * N.NEIGHBOURS * holes.count())


@pytest.mark.parametrize("frequent", [32, 0])
def test_leaves_are_exact(df, monkeypatch, frequent):
    """Within a cell, a question of a frequent pattern or of another is compared with every donor that
    may be near."""
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "LEAF", 8)
    model = N.fit_neighbours(df, NUMBERS, WORDS)
    holes = N.holes_of(df, model)
    near = {}
    for r in N.neighbours(model, holes).collect():
        near.setdefault((r.question, r.target), []).append(r.distance)
    for key, distances in brute(model, holes).items():
        assert sorted(near[key]) == pytest.approx(np.sort(distances)[:N.NEIGHBOURS], abs=1e-9)


def test_cells_visited(spark, monkeypatch):
    """Donors are dealt out once, and a question goes to few cells, though all cells are cut along a
    column that many questions lack."""
    key = F.col("id")
    lines = spark.range(40_000).select(
        F.when(key % 9 != 0, F.pmod(F.hash(key), F.lit(50)).cast("double")).alias("quantity"),
        F.pmod(F.xxhash64(key), F.lit(10_000_019)).alias("price"),
        (F.pmod(F.hash(key + 1), F.lit(11)) / 100).alias("discount"),
        F.when(key % 17 != 0, F.concat(F.lit("f"), F.pmod(F.hash(key + 2), F.lit(3)))).alias("flag"))
    dealt, meet = [], N._meet
    monkeypatch.setattr(N, "_meet", lambda model, donors, visits: dealt.append(visits) or meet(
        model, donors, visits))
    model = N.fit_neighbours(lines, ["quantity", "price", "discount"], ["flag"])
    holes = N.holes_of(lines, model)
    near = N.neighbours(model, holes)
    assert near.count() == N.NEIGHBOURS * sum(
        holes.where(f"q{i} IS NULL").count() for i in range(4))
    assert len(dealt) == 1 and dealt[0].count() <= 3 * holes.count()


def test_facts_of_copies(spark):
    """Means and deviations count every copy, and equal values have no rounding."""
    rows = [(0.1, 1.0, "u")] * 3 + [(0.1, 4.0, "v")] + [(0.1, None, "v")] * 3 + [(None, None, None)] * 5
    model = N.fit_neighbours(spark.createDataFrame(rows, "a double, b double, c string"), ["a", "b"], ["c"])
    c = model.coordinates
    assert model.n_donors == 3 and c.means == pytest.approx([0.1, 1.75], abs=0) and c.fills[2] == "v"
    assert c.deviations == pytest.approx([1.0, np.std([1, 1, 1, 4])], abs=1e-15)
