"""Categories, checks and derived columns: values written by hand, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import categories as C
from furrow.operators import checks as K
from furrow.operators import derive as D


def test_written_numbers(spark):
    known = {
        "12": 12.0, " -3.5 ": -3.5, "1e3": 1000.0, "12.5%": 0.125, "50 %": 0.5, "$1,234.50": 1234.5,
        "(1,234)": -1234.0, "($5)": -5.0, "-€ 7": -7.0, "3 USD": 3.0, "1,234,567": 1234567.0, "¥10": 10.0,
        "1,5": None, "12,34,567": None, "(-3)": None, "n/a": None, "": None, "1d": None, "NaN": None,
        "$": None, "%": None, "5%%": None, "()": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in known], "x string").withColumn(
        "n", D.parse_number(F.col("x")))
    assert {r["x"]: r["n"] for r in df.collect()} == known
    report = D.parse_report(df, ["x"]).head()
    assert (report["present"], report["parsed"], report["rejected"]) == (23, 12, 11)


def test_serial_dates(spark):
    known = {"61": "1900-03-01", "45292": "2024-01-01", "45292.75": "2024-01-01", "60": None, "-1": None,
             "2958465": "9999-12-31", "2958466": None, "2024-01-01": None}
    df = spark.createDataFrame([(k,) for k in known], "x string")
    got = df.select("x", D.parse_serial_date(F.col("x")).cast("string").alias("d")).collect()
    assert {r["x"]: r["d"] for r in got} == known


def test_date_parts(spark):
    df = spark.createDataFrame([("2024-03-31 23:10:00", 1), ("no date", 2), (None, 3)], "`t.x` string, id int")
    got = {r["id"]: r for r in D.date_features(df, ["t.x"]).collect()}
    assert list(got[1])[1:] == [2024, 1, 3, 31, 7, 23, 1]
    assert list(got[2])[1:] == list(got[3])[1:] == [None] * 7
    with pytest.raises(M.PreparationError, match="exist already"):
        D.date_features(df.withColumn("t.x__year", F.lit(1)), ["t.x"])


def test_combinations(spark):
    df = spark.createDataFrame([(6.0, "2"), (1.0, "0"), (1.0, "x"), (None, "1"), (1e308, "1e-10")],
                               "a double, b string")
    got = D.combine(df, {"r": ("a", "ratio", "b"), "s": ("a", "sum", "b")}).collect()
    assert [r["r"] for r in got] == [3.0, None, None, None, None]
    assert [r["s"] for r in got][:4] == [8.0, 1.0, None, None]


def test_scales_and_bins(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(9)] + [(None, None)], "x double, k double")
    state = D.ScaleState.from_json(D.fit_scales(df, ["x", "k"], {"x": 4}, {"k": 3}).to_json())
    assert state.robust == {"x": [4.0, 4.0], "k": [5.0, 1.0]}
    assert state.edges == {"x": [2.0, 4.0, 6.0], "k": []}
    scaled = D.scale_robust(df, state).collect()
    assert [r["x"] for r in scaled][:3] == [-1.0, -0.75, -0.5] and scaled[-1]["x"] is None
    assert {r["k"] for r in scaled} == {0.0, None}
    binned = D.bin_numbers(df, state).collect()
    assert [r["x"] for r in binned] == [0, 0, 1, 1, 2, 2, 3, 3, 3, None]
    logs = D.log_transform(df, ["x"]).collect()
    assert math.isclose(logs[3]["x"], math.log(4)) and logs[-1]["x"] is None
    with pytest.raises(M.PreparationError, match="no value"):
        D.fit_scales(df.where("x < 0"), ["x"])


def test_rare_values(spark):
    rows = [("a",)] * 50 + [(" a ",)] * 10 + [("b",)] * 30 + [("c",)] * 3 + [(None,)] * 7
    df = spark.createDataFrame(rows, "x string")
    rare = {r["value"]: r["n"] for r in C.rare_categories(df, ["x"]).collect()}
    assert rare == {"c": 3}
    state = C.CommonValues.from_json(C.fit_common(df, ["x"]).to_json())
    assert state.values == {"x": ["a", "b"]}
    merged = C.merge_rare(df.union(spark.createDataFrame([("new",)], "x string")), state)
    assert {r["x"]: r["count"] for r in merged.groupBy("x").count().collect()} == {
        "a": 60, "b": 30, C.OTHER_LABEL: 4, None: 7}
    empty = C.fit_common(df.where("x = 'z'"), ["x"])
    assert C.merge_rare(df, empty).where(f"x = '{C.OTHER_LABEL}'").count() == 93


def test_near_constant_columns(spark):
    df = spark.range(200).selectExpr("if(id = 1, 'b', 'a') x", "if(id < 3, 'a', null) y", "id % 50 z")
    found = {r["column"]: (r["value"], r["n"]) for r in C.near_constant(df, ["x", "y", "z"], 0.985).collect()}
    assert found == {"x": ("a", 199), "y": (None, 197)}
    assert C.near_constant(df.where("z > 50"), ["x"]).count() == 0


@pytest.mark.parametrize("size, per_class", [("most", 70), ("least", 7)])
def test_resampled_classes_are_equal(spark, size, per_class):
    df = spark.range(100).selectExpr(
        "id", "case when id < 70 then 'a' when id < 90 then 'b' when id < 97 then 'c' end t")
    got = C.resample(df, "t", ["id"], size).collect()
    counts = {}
    for r in got:
        counts[r["t"]] = counts.get(r["t"], 0) + 1
    assert counts == {"a": per_class, "b": per_class, "c": per_class}
    again = C.resample(df.repartition(7), "t", ["id"], size).collect()
    assert sorted(again) == sorted(got)
    # Copies of a row are numbered without gaps, and differ by one round at most.
    per_row = {}
    for r in got:
        per_row.setdefault(r["id"], []).append(r["copy"])
    assert all(sorted(v) == list(range(len(v))) for v in per_row.values())
    for label in "abc":
        sizes = [len(per_row.get(i, [])) for i in range(97) if ("a" if i < 70 else "b" if i < 90 else "c") == label]
        assert max(sizes) - min(sizes) <= 1


def test_resampling_equal_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a")] * 9 + [(1, "b")] * 4, "id long, t string")
    for size, n in (("most", 9), ("least", 4)):
        counts = {r["t"]: r["count"] for r in C.resample(df, "t", ["id"], size).groupBy("t").count().collect()}
        assert counts == {"a": n, "b": n}
    assert C.resample(df.where("id = 2"), "t", ["id"]).columns == ["id", "t", "copy"]
    with pytest.raises(M.PreparationError, match="named copy"):
        C.resample(df.withColumn("copy", F.lit(1)), "t", ["id"])


def test_class_balance(spark):
    df = spark.createDataFrame([("a",)] * 85 + [("b",)] * 15 + [(None,)] * 5, "t string")
    row = C.class_imbalance(df, "t").head()
    assert (row["rows"], row["classes"], row["least_share"], row["level"]) == (100, 2, 0.15, "imbalanced")
    assert sum(r["n"] * r["weight"] for r in C.class_weights(df, "t").collect()) == pytest.approx(100)
    none = C.class_imbalance(df.where("t = 'z'"), "t").head()
    assert (none["rows"], none["classes"], none["level"]) == (0, 0, None)


def test_encodings(spark):
    df = spark.createDataFrame([("no",), (" yes",), ("no",), (None,)], "x string")
    values = C.fit_binary(df, "x")
    assert values == ["no", "yes"]
    new = df.union(spark.createDataFrame([("maybe",)], "x string"))
    assert [r[0] for r in new.select(C.encode_binary(F.col("x"), values)).collect()] == [0, 1, 0, None, None]
    assert [r[0] for r in new.select(C.encode_ordinal(F.col("x"), ["no", "yes"])).collect()] == [0, 1, 0, None, -1]
    shares = C.encode_frequency(new, C.fit_frequencies(df, ["x"]), {"x": "share"}).collect()
    assert sorted((str(r["x"]), r["share"]) for r in shares) == [
        (" yes", 0.25), ("None", 0.25), ("maybe", 0.0), ("no", 0.5), ("no", 0.5)]
    with pytest.raises(M.PreparationError, match="two values"):
        C.fit_binary(new, "x")


def test_rules(spark):
    df = spark.createDataFrame([(1, "5", "x"), (1, "no", None), (2, None, "y"), (None, "11", "z")],
                               "k int, n string, t string")
    rules = [K.Rule("n", K.RANGE, ["n"], 0, 10), K.Rule("t", K.NOT_NULL, ["t"]),
             K.Rule("set", K.IN_SET, ["t"], values=["x", "y"]), K.Rule("key", K.UNIQUE, ["k"]),
             K.Rule("pair", K.UNIQUE, ["k", "n"]), K.Rule("form", K.PATTERN, ["t"], pattern="^[xz]$")]
    got = {r["rule"]: r["violations"] for r in K.validate_rules(df, rules).collect()}
    assert got == {"n": 2, "t": 1, "set": 1, "key": 1, "pair": 0, "form": 1}
    rows = {r["n"]: r["broken_rules"] for r in K.violations(df, rules).collect()}
    assert rows == {"no": ["n", "t"], None: ["form"], "11": ["n", "set"]}
    empty = {r["rule"]: (r["rows"], r["violations"]) for r in K.validate_rules(df.limit(0), rules).collect()}
    assert set(empty.values()) == {(0, 0)}
    with pytest.raises(M.PreparationError, match="no such kind"):
        K.validate_rules(df, [K.Rule("n", "odd", ["n"])])


def test_repeats_and_conflicts(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (1, "a", None), (None, "b", "p"),
                                (None, "b", "p"), (2, "c", "q")], "k int, f string, t string")
    repeats = {(r["k"], r["n"]) for r in K.duplicates_by_key(df, ["k"]).collect()}
    assert repeats == {(1, 3), (None, 2)}
    assert [tuple(r) for r in K.target_conflicts(df, ["k", "f"], "t").collect()] == [(1, "a", 2, 2)]
