import pytest

from furrow import model as M
from furrow.operators import split as S


def counts(rows, *keys):
    return {tuple(r)[:-1]: r["count"] for r in rows.groupBy(*keys, S.SPLIT).count().collect()}


def as_set(rows, key):
    return {r[key] for r in rows.where("split = 'test'").collect()}


def test_exact_counts_and_quotas(spark):
    df = spark.range(1003).selectExpr(
        "id", "case when id % 3 = 0 then 'a' when id % 7 = 0 then 'b' else 'c' end as c")
    split = S.split_rows(df, 0.2, 42, ["id"], "c")
    quotas = {r["_class"]: (r["rows"], r["quota"]) for r in split.quotas.collect()}
    assert sum(q for _, q in quotas.values()) == split.n_test == 201
    for label, (rows, quota) in quotas.items():
        assert abs(quota - rows * 201 / 1003) < 1
        found = counts(split.rows, "c")
        assert found[(label, "test")] == quota and found[(label, "train")] == rows - quota
    assert split.rows.select("id").distinct().count() == 1003


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_same_split_for_any_partitioning(spark, partitions):
    df = spark.range(400).selectExpr("id", "id % 3 as c")
    want = as_set(S.split_rows(df, 0.25, 3, ["id"], "c").rows, "id")
    again = S.split_rows(df.repartition(partitions), 0.25, 3, ["id"], "c").rows
    assert as_set(again, "id") == want


@pytest.mark.parametrize("ranked", [1, 20, 100_000])
def test_narrowing_by_prefix_changes_nothing(spark, ranked):
    df = spark.range(900).selectExpr("id", "id % 2 as c")
    want = as_set(S.split_rows(df, 0.3, 5, ["id"], "c").rows, "id")
    assert as_set(S.split_rows(df, 0.3, 5, ["id"], "c", ranked).rows, "id") == want


def test_another_seed_gives_another_split(spark):
    df = spark.range(200).toDF("id")
    first = as_set(S.split_rows(df, 0.2, 1, ["id"]).rows, "id")
    assert first != as_set(S.split_rows(df, 0.2, 2, ["id"]).rows, "id") and len(first) == 40


@pytest.mark.parametrize("key", [None, ["hot"], ["c"]])
@pytest.mark.parametrize("stratify", [None, "c"])
def test_copies_of_one_row_are_divided_by_number(spark, monkeypatch, key, stratify):
    monkeypatch.setattr(S, "COPIES_PER_TASK", 50)
    df = spark.range(900).selectExpr("case when id < 500 then 0 else id end as hot", "id % 3 as c")
    split = S.split_rows(df.repartition(6), 0.25, 9, key, stratify, ranked_rows=10)
    assert split.rows.where("split = 'test'").count() == split.n_test == 225
    kept = split.rows.groupBy("hot", "c").count()
    assert kept.exceptAll(df.groupBy("hot", "c").count()).count() == 0
    assert split.rows.count() == 900
    if stratify:
        assert {v for k, v in counts(split.rows, "c").items() if k[1] == "test"} == {75}


def test_rounding_ties_go_to_the_larger_class(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 15)], "_class string, rows bigint")
    quotas = {r["_class"]: r["quota"] for r in S.split_quotas(df, 25, 5).collect()}
    assert quotas == {"a": 1, "b": 1, "c": 3}
    odd = spark.createDataFrame([("a", 6), ("b", 6)], "_class string, rows bigint")
    assert {r["_class"]: r["quota"] for r in S.split_quotas(odd, 12, 3).collect()} == {
        "a": 2, "b": 1}


def test_quota_products_beyond_64_bits(spark):
    rows = [("a", 700_000_000_000), ("b", 300_000_000_000)]
    df = spark.createDataFrame(rows, "_class string, rows bigint")
    quotas = S.split_quotas(df, 10**12, 2 * 10**11).collect()
    assert {r["_class"]: r["quota"] for r in quotas} == {"a": 14 * 10**10, "b": 6 * 10**10}


def problems(spark, sizes, task, rejected=0, **knobs):
    rows = [(f"k{i}", n) for i, n in enumerate(sizes)]
    classes = spark.createDataFrame(rows, "_class string, rows bigint")
    found = S.split_preconditions(classes, task, M.PipelineConfig(**knobs), rejected)
    return {r["problem"] for r in found.collect()}


def test_preconditions(spark):
    assert problems(spark, [10, 10], "classification") == set()
    assert problems(spark, [2, 2], "classification") == {
        "too_few_rows", "test_smaller_than_classes"}
    assert problems(spark, [30], "classification") == {"too_few_classes"}
    assert problems(spark, [30, 1], "classification") == {"class_too_small"}
    assert problems(spark, [30, 1], "classification", stratify_classification=False) == set()
    assert problems(spark, [2] * 6, "classification") == {"test_smaller_than_classes"}
    assert problems(spark, [30], "regression") == set()
    assert problems(spark, [30], "regression", rejected=2) == {"target_not_numeric"}


def test_duplicates_treat_null_and_nan_as_equal(spark):
    df = spark.sql("""select * from values (1, null, double('NaN')), (1, null, double('NaN')),
        (1, 'a', 0.5D) as t(a, b, c)""")
    assert S.drop_duplicates(df).count() == 2


def test_strict_numbers(spark):
    texts = ["1", "-2.5", ".5", "1e3", "", " 7 ", "1d", "NaN", "0x10", "1,000", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert S.strict_numeric(df, ["x"]).head()["rejected"] == 6


@pytest.mark.parametrize("bad", [
    {"test_size": 0.05}, {"test_size": 0.6}, {"random_seed": -1}, {"max_categories": 1},
    {"max_categories": 501}, {"scaling": "robust"}, {"numeric_imputation": "mode"},
    {"categorical_imputation": "none"}])
def test_knobs_are_bounded(bad):
    with pytest.raises(M.PreparationError):
        M.PipelineConfig(**bad)


@pytest.mark.parametrize("stratify", [None, "c"])
def test_ties_in_every_type_keep_every_row(spark, stratify):
    """Rows with one key token that differ below the millisecond, or only in nested values."""
    df = spark.range(60).selectExpr(
        "1 AS hot", "id % 2 AS c", "timestamp_micros(id % 5) AS at",
        "timestampadd(MICROSECOND, id % 5, timestamp_ntz'2020-01-01') AS local",
        "CASE WHEN id % 3 = 0 THEN 0.0D WHEN id % 3 = 1 THEN -0.0D ELSE 1e-9D END AS x",
        "CASE WHEN id % 4 = 0 THEN 'a|b' WHEN id % 4 = 1 THEN NULL ELSE 'a' END AS t",
        "array(timestamp_micros(id % 7), NULL) AS many")
    split = S.split_rows(df.repartition(3), 0.2, 5, ["hot"], stratify, ranked_rows=4)
    assert split.rows.count() == 60
    assert split.rows.where("split = 'test'").count() == split.n_test == 12
    assert split.rows.drop("split").exceptAll(df).count() == 0
