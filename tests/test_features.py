"""Target encoding, spellings and dependence of columns: hand-made and brute-force cases."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import dependence, spellings
from furrow.operators import target_encoding as E


# ---- target encoding ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sales(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice(["a", " a ", "b", None, "rare" if k == 7 else "c"]), draw.random(),
             draw.choice(["yes", "no"]) if k % 9 else None) for k in range(300)]
    return spark.createDataFrame(rows, "id long, shop string, price double, bought string")


def encoded(df, by="id", value="shop__target"):
    return {r[by]: r[value] for r in df.collect()}


def test_target_encoding_against_loops(sales):
    fitted = E.fit_target_encoding(sales, ["shop"], "bought", ["id"], "yes", folds=4, smoothing=3.0)
    rows = sales.withColumn("fold", E.fold_of(["id"], 4, E.SEED)).collect()
    label = {r.id: (r.shop or M.MISSING_LABEL).strip() for r in rows}
    found = encoded(E.encode_training(sales, fitted))
    for r in rows:
        others = [o for o in rows if o.fold != r.fold and o.bought is not None]
        prior = sum(o.bought == "yes" for o in others) / len(others)
        same = [o.bought == "yes" for o in others if label[o.id] == label[r.id]]
        assert found[r.id] == pytest.approx((sum(same) + 3 * prior) / (len(same) + 3))


def test_no_row_sees_its_own_target(sales):
    """Another target of one row changes no value in its fold."""
    changed = sales.withColumn("price", F.when(F.col("id") == 5, 1e6).otherwise(F.col("price")))
    fold = encoded(sales.withColumn("fold", E.fold_of(["id"], E.FOLDS, E.SEED)), value="fold")
    one, other = (encoded(E.encode_training(df, E.fit_target_encoding(df, ["shop"], "price", ["id"])))
                  for df in (sales, changed))
    same = [k for k in one if one[k] == other[k]]
    assert 5 in same and {k for k in fold if fold[k] == fold[5]} <= set(same)
    assert len(same) < len(one)


def test_rows_outside_of_training(spark, sales):
    fitted = E.fit_target_encoding(sales, ["shop"], "price", ["id"], smoothing=2.0)
    new = spark.createDataFrame([(1, "a"), (2, "unheard"), (3, None)], "id long, shop string")
    found = encoded(E.encode_others(new, fitted))
    rows = sales.collect()
    mean = sum(r.price for r in rows) / len(rows)
    own = [r.price for r in rows if r.shop in ("a", " a ")]
    assert found[1] == pytest.approx((sum(own) + 2 * mean) / (len(own) + 2))
    assert found[2] == pytest.approx(mean)


def test_target_encoding_edges(spark, sales):
    copies = spark.createDataFrame([(1, "a", 2.0)] * 8, "id long, shop string, y double")
    fitted = E.fit_target_encoding(copies, ["shop"], "y", ["id"])
    assert [r.shop__target for r in E.encode_training(copies, fitted).collect()] == [None] * 8
    empty = E.fit_target_encoding(copies.where("false"), ["shop"], "y", ["id"])
    assert [r.shop__target for r in E.encode_others(copies, empty).collect()] == [None] * 8
    bare = E.fit_target_encoding(sales, ["shop"], "price", ["id"], smoothing=0.0)
    assert E.encode_others(sales, bare).count() == 300
    for wrong in ({"folds": 1}, {"smoothing": -1.0}, {"columns": ["price"]}):
        with pytest.raises(M.PreparationError):
            E.fit_target_encoding(sales, **{"columns": ["shop"], "target": "price", **wrong})
    with pytest.raises(M.PreparationError, match="exist already"):
        E.encode_others(copies.withColumn("shop__target", F.lit(1)), fitted)


# ---- spellings ----------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_spellings_against_all_pairs(spark, edits):
    """Short and long values, and lengths on both sides of where the methods change."""
    draw = random.Random(edits)
    values = {"", "a", "éclair", "eclair", "Éclair"}
    for length in [5, 7, 12, 22, 24, 25, 26, 27, 28, 30, 60] * 2:
        word = "".join(draw.choice("abcdé") for _ in range(length))
        values.add(word)
        for _ in range(6):
            other = list(word)
            for _ in range(draw.randint(1, edits + 1)):
                at = draw.randrange(len(other) + 1)
                kind = draw.randrange(3)
                if kind == 0:
                    other.insert(at, draw.choice("abx"))
                elif at < len(other):
                    other[at:at + 1] = [] if kind == 1 else [draw.choice("abx")]
            values.add("".join(other))
    counts = spark.createDataFrame([(v, k % 3 + 1) for k, v in enumerate(sorted(values))],
                                   "value string, n long")
    found = {(r.value, r.other): r.distance
             for r in spellings.near_spellings(counts, edits, 4).collect()}
    want = {(a, b): distance(a, b) for a, b in itertools.combinations(sorted(values), 2)
            if min(len(a), len(b)) >= 4 and distance(a, b) <= edits}
    assert found == want and len(want) > 40


def test_suggestions(spark):
    rows = [("London",)] * 5 + [("london",)] * 2 + [("LONDON ",)] * 2 + [("Londom",), (None,), ("Rome",)]
    counts = spellings.value_counts(spark.createDataFrame(rows, "city string"), "city")
    assert {(r.value, r.n, r.suggestion) for r in spellings.case_variants(counts).collect()} == {
        ("London", 5, "London"), ("london", 2, "London"), ("LONDON", 2, "London")}
    near = {(r.value, r.other): r.suggestion for r in spellings.near_spellings(counts).collect()}
    assert near[("Londom", "London")] == "London" and ("LONDON", "London") not in near
    assert spellings.near_spellings(counts.where("false")).count() == 0


# ---- dependence ---------------------------------------------------------------------------------

def test_duplicate_columns(spark):
    df = spark.createDataFrame(
        [(1, "x", 1, None, 0.0, "1"), (2, None, 2, None, -0.0, "2"), (3, "x", 3, None, 1.0, "3")],
        "a int, b string, c long, d string, e double, f string").withColumns({
            "b.again": F.col("b"), "swapped": F.reverse("b"), "g": F.abs("e")})
    found = {(r.column, r.duplicate_of) for r in dependence.duplicate_columns(df).collect()}
    assert found == {("c", "a"), ("f", "a"), ("b.again", "b"), ("swapped", "b"), ("g", "e")}
    assert dependence.duplicate_columns(df.where("false")).count() == 0
    # The same values in other rows are no duplicate.
    rolled = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a int, b int")
    assert dependence.duplicate_columns(rolled).count() == 0


def test_mutual_information_against_loops(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.choice(["u", None, "v"]), draw.random()) for _ in range(200)]
    rows = [(a, b, "k", x, a + "!", 1.5 if a == "a" else None) for a, b, x in rows]
    df = spark.createDataFrame(rows, "a string, b string, one string, x double, same string, h double")
    found = {(r.a, r.b): r for r in dependence.mutual_information(
        df, binned=["x", "h"], bins=4, pairs_a_pass=5).collect()}
    assert len(found) == 15
    low, high = min(r[3] for r in rows), max(r[3] for r in rows)
    cells = {"a": [r[0] for r in rows], "b": [r[1] for r in rows], "one": [r[2] for r in rows],
             "x": [min(3, math.floor((r[3] - low) / (high - low) * 4)) for r in rows],
             "same": [r[4] for r in rows], "h": [r[5] for r in rows]}

    def entropy(values):
        n = [values.count(v) for v in set(values)]
        return math.log(len(values)) - sum(k * math.log(k) for k in n) / len(values)

    for (a, b), r in found.items():
        mi = entropy(cells[a]) + entropy(cells[b]) - entropy(list(zip(cells[a], cells[b])))
        assert r.mi == pytest.approx(max(mi, 0), abs=1e-9)
    assert found[("a", "same")].normalized == pytest.approx(1)
    assert found[("a", "one")].normalized == 0 and found[("a", "h")].normalized == pytest.approx(1)


def entropies(rows, names):
    """Entropy of every column and pair of columns, by loops."""
    def of(*places):
        n = Counter(tuple(r[i] for i in places) for r in rows).values()
        return math.log(len(rows)) - sum(k * math.log(k) for k in n) / len(rows)

    places = range(len(names))
    return {(names[i], names[j]): (of(i), of(j), of(i, j))
            for i, j in itertools.combinations(places, 2)}


@pytest.mark.parametrize("task", [100, 100_000])
def test_mutual_information_of_wide_columns(spark, monkeypatch, task):
    """Keys, digests, frequent values, nulls and equal columns, counted by tasks of few and many rows."""
    monkeypatch.setattr(dependence, "ROWS_A_TASK", task)
    monkeypatch.setattr(dependence, "LISTED", 600)
    monkeypatch.setattr(dependence, "FEW_CELLS", 100)
    draw = random.Random(9)
    rows = []
    for k in range(3_000):
        key = draw.choice([None, 7, draw.randrange(10 ** 15), draw.randrange(-1_500, 1_500)])
        text = "often" if draw.random() < 0.4 else f"t{draw.randrange(1_400)}"
        rows.append((key, text, key, draw.randrange(500), draw.choice("ab"), 2 ** 62 * (k % 3 - 1),
                     bool(k % 2), k // 2, 5))
    names = ["key", "text", "again", "some", "few", "far", "flag", "half", "one"]
    df = spark.createDataFrame(rows, "key long, text string, again long, some int, few string, "
                                     "far long, flag boolean, half int, one int")
    found = {(r.a, r.b): r for r in dependence.mutual_information(df, pairs_a_pass=7).collect()}
    want = entropies(rows, names)
    assert set(found) == set(want)
    for pair, (a, b, both) in want.items():
        r = found[pair]
        assert (r.h_a, r.h_b, r.mi) == pytest.approx((a, b, max(a + b - both, 0)), abs=1e-9), pair
    empty = dependence.mutual_information(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["a", "b", "mi", "h_a", "h_b", "normalized"]


def test_mutual_information_moves_rows_once_per_key(spark):
    """Two columns of keys beside ten of few values: not a row per pair of columns."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written():
        found, at = {}, files.getAllFiles().iterator()
        while at.hasNext():
            f = at.next()
            if f.getName().startswith("shuffle_"):
                found[f.getName()] = f.length()
        return found

    df = spark.range(40_000).select(
        F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"),
        *[F.pmod(F.hash("id", F.lit(i)), F.lit(5 + i)).alias(f"c{i}") for i in range(10)])
    before = written()
    assert dependence.mutual_information(df).count() == 66
    moved = sum(n for name, n in written().items() if name not in before)
    # 23 pairs of columns hold a key, 40,000 rows and more than 8 bytes each: over 7 MB as pairs.
    assert moved < 3_500_000
