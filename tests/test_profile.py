import pytest

from furrow import model as M
from furrow.operators import profile as P
from furrow.operators import quality as Q
from furrow.operators import recommend as C
from furrow.operators import roles as R


def by_column(df, value):
    return {r["column"]: r[value] for r in df.collect()}


def scores(profile, task):
    return {r["dimension"]: r["score"] for r in Q.quality_report(profile, task).collect()}


def hexed(rule, column):
    return f"{rule}:{column.encode().hex()}"


def test_churn_profile_roles_scores(churn):
    profile = R.infer_roles(P.column_profile(churn, ["customer_id"])).persist()
    assert [r["unique_count"] for r in profile.orderBy("ordinal").collect()] == [5, 4, 3, 5, 3, 2]
    assert [r["missing_count"] for r in profile.orderBy("ordinal").collect()] == [0, 1, 0, 1, 0, 0]
    assert by_column(profile, "role") == {
        "customer_id": "id", "age": "discrete_numeric", "city": "nominal_category",
        "monthly_fee": "discrete_numeric", "contract_type": "nominal_category",
        "churn": "nominal_category"}
    assert by_column(profile, "examples")["city"] == ["上海", "北京", "上海"]
    assert by_column(profile, "examples")["age"] == ["28", "45", "37"]
    assert scores(profile, "classification") == {
        "completeness": 93, "validity": 100, "consistency": 90, "uniqueness": 100,
        "structure_usability": 95, "task_readiness": 65, "total": 90}
    recs = C.recommendations(profile, "classification")
    assert {r["id"]: r["enabled"] for r in recs.collect()} == {
        "BD-TARGET-001:project": False, hexed("BD-ID-001", "customer_id"): True,
        hexed("BD-MISSING-002", "age"): True, hexed("BD-MISSING-002", "monthly_fee"): True}
    profile.unpersist()


def test_small_analysis_scores_conflicts_and_selection(small_analysis):
    profile = R.infer_roles(P.column_profile(small_analysis, ["customer_id"])).persist()
    assert scores(profile, "classification") == {
        "completeness": 80, "validity": 100, "consistency": 90, "uniqueness": 85,
        "structure_usability": 95, "task_readiness": 65, "total": 86}
    recs = C.recommendations(profile, "classification").persist()
    found = {r["id"]: r for r in recs.collect()}
    high, marked = hexed("BD-MISSING-001", "mostly_missing"), hexed(
        "BD-MISSING-002", "mostly_missing")
    assert found[high]["conflicts_with"] == [marked]
    assert found[marked]["conflicts_with"] == [high]
    assert found[hexed("BD-CONSTANT-001", "constant")]["enabled"]
    assert found[hexed("BD-ID-001", "customer_id")]["confidence"] == 0.9
    assert found[high]["parameters"] == {"missing_rate_threshold": "0.5"}
    with pytest.raises(M.PreparationError, match="conflict"):
        C.select_recommendations(recs, [high, marked])
    with pytest.raises(M.PreparationError, match="unknown"):
        C.select_recommendations(recs, ["nothing"])
    with pytest.raises(M.PreparationError, match="duplicate"):
        C.select_recommendations(recs, [high, high])
    chosen = C.select_recommendations(recs, [high])
    assert [r["id"] for r in chosen.where("enabled").collect()] == [high]
    recs.unpersist()
    profile.unpersist()


def test_confirming_roles(small_analysis):
    profile = P.column_profile(small_analysis, ["customer_id"])
    nominal = [(c, "nominal_category") for c in small_analysis.columns]
    with pytest.raises(M.PreparationError, match="target_count: 0"):
        R.confirm_roles(profile, nominal, "classification")
    with pytest.raises(M.PreparationError, match="missing_column: churn"):
        R.confirm_roles(profile, nominal[:-1], "cleaning")
    with pytest.raises(M.PreparationError, match="unknown_column: other"):
        R.confirm_roles(profile, [*nominal, ("other", "id")], "cleaning")
    with pytest.raises(M.PreparationError, match="duplicate_column: age"):
        R.confirm_roles(profile, [*nominal, ("age", "id")], "cleaning")
    with pytest.raises(M.PreparationError, match="unknown_role"):
        R.confirm_roles(profile, [*nominal[:-1], ("churn", "label")], "cleaning")
    with pytest.raises(M.PreparationError, match="target_count: 1"):
        R.confirm_roles(profile, [*nominal[:-1], ("churn", "target")], "cleaning")
    confirmed = R.confirm_roles(profile, [*nominal[:-1], ("churn", "target")], "classification")
    assert by_column(confirmed, "role")["churn"] == "target"
    ids = [r["rule_id"] for r in C.recommendations(confirmed, "classification").collect()]
    assert "BD-TARGET-001" not in ids


def test_sampled_import(spark):
    rows = [("C001", 31, "上海", False), ("C002", None, "北京", True), ("C003", 44, "上海", False),
            ("C004", 28, "深圳", False)]
    df = spark.createDataFrame(rows, "customer_id string, age int, city string, churned boolean")
    sample, is_sampled = P.head_sample(df, ["customer_id"], 3)
    assert is_sampled and sample.count() == 3
    table = P.dataset_profile(df, ["customer_id"], 3).head()
    assert (table["sampled_rows"], table["is_sampled"], table["column_count"]) == (3, True, 4)
    assert table["missing_cells"] == 1 and "first 3 rows" in table["warning"]
    preview = P.preview_rows(df, ["customer_id"]).collect()
    assert preview[1]["age"] is None and preview[0]["churned"] == "false"
    whole = P.dataset_profile(df, ["customer_id"]).head()
    assert (whole["sampled_rows"], whole["is_sampled"], whole["warning"]) == (4, False, None)
    assert P.head_sample(df, ["customer_id"], 4)[1] is False


def test_types_of_every_kind(spark):
    df = spark.sql("""select * from values
        (1L, 0.0D, 'a', true, date'2024-01-01', array(1), map('k', 1), null),
        (2L, -0.0D, ' ', null, date'2024-01-02', array(2), null, null)
        as t(k, zero, s, b, d, l, m, nothing)""")
    found = {r["column"]: r for r in R.infer_roles(P.column_profile(df, ["k"])).collect()}
    assert found["zero"]["unique_count"] == 1
    assert found["b"]["unique_count"] == 2 and found["b"]["role"] == "boolean"
    assert found["d"]["role"] == "datetime"
    assert found["l"]["inferred_type"] == "List" and found["l"]["unique_count"] is None
    assert found["m"]["missing_count"] == 1 and found["m"]["role"] == "ignore"
    assert found["nothing"]["inferred_type"] == "Unknown"
    assert found["s"]["missing_count"] == 0
    profile = R.infer_roles(P.column_profile(df, ["k"]))
    assert scores(profile, "cleaning")["validity"] == 80


def test_empty_table(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    found = {r["column"]: r for r in P.column_profile(df, ["a"]).collect()}
    assert found["a"]["rows"] == 0 and found["b"]["missing_rate"] == 0.0
    assert found["b"]["examples"] == []
    assert scores(R.infer_roles(P.column_profile(df, ["a"])), "cleaning")["completeness"] == 0


def test_examples_of_columns_empty_at_the_head(spark):
    df = spark.range(500).selectExpr(
        "id", "case when id in (300, 301, 450, 460) then concat('v', id) end as late",
        "cast(null as string) as never")
    found = by_column(P.example_values(df.repartition(5), ["id"], head=10), "examples")
    assert found == {"id": ["0", "1", "2"], "late": ["v300", "v301", "v450"], "never": []}


def test_large_head_equals_plain_order(spark, monkeypatch):
    df = spark.range(3000).selectExpr("(id * 7919) % 3001 as k", "id as v").repartition(9)
    want = [r["k"] for r in df.orderBy("k").limit(700).collect()]
    ranked = P.first_rows(df, ["k"], 700)
    assert [r["k"] for r in ranked.collect()] == want
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    monkeypatch.setattr(P, "PLAIN_TOP", 1000)
    assert [r["k"] for r in P.first_rows(df, ["k"], 700).collect()] == want


def test_ranks_beyond_the_default_limit_are_still_cut_early(spark):
    df = spark.range(5000).toDF("k").repartition(4)
    ranked = P.first_rows(df, ["k"], 1500)
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r["k"] for r in ranked.collect()] == list(range(1500))


def test_long_texts_are_told_apart_beyond_any_prefix(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",)], "t string")
    assert P.unique_stats(df).head()["unique_count"] == 2


def test_approximate_distinct_counts_null_once(spark):
    df = spark.range(1000).selectExpr("id % 10 as a", "nullif(id % 4, 0) as b")
    assert by_column(P.unique_stats(df, exact=False), "unique_count") == {"a": 10, "b": 4}


@pytest.mark.parametrize("previous, on", [(None, 3), ([], 0), (["BD-TARGET-001:project"], 1)])
def test_enablement(churn, previous, on):
    profile = R.infer_roles(P.column_profile(churn, ["customer_id"]))
    recs = C.enable(C.recommendations(profile, "classification"), previous)
    assert recs.where("enabled").count() == on
