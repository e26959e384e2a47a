"""The query registry: every operator over the given tables, with comparable output columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import model as M
from furrow.functions.text import normalize_category, quoted, strict_double
from furrow.operators import catalog, evaluate, fit, manifest, metrics, quality, recommend
from furrow.operators import profile as P
from furrow.operators import roles as R
from furrow.operators import split as S
from furrow.operators import transform as X
from furrow.plans import evaluation, pipeline, report
from furrow.plans.dirty import events_holed, labels_cls, lineitem_reg, orders_dirty, table
from furrow.plans.workbooks import write_workbooks
from furrow.session import materialize, new_path, small_table
from furrow.sources import csv as C
from furrow.sources import dialects, tables, xlsx
from furrow.streaming import apply

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ORDER_ROLES = {
    "o_orderkey": M.ID, "o_custkey": M.CONTINUOUS_NUMERIC, "o_orderstatus": M.TARGET,
    "o_totalprice": M.CONTINUOUS_NUMERIC, "o_orderdate": M.IGNORE,
    "o_orderpriority": M.NOMINAL_CATEGORY, "const_col": M.NOMINAL_CATEGORY,
    "mostly_missing": M.NOMINAL_CATEGORY, "num_text": M.IGNORE,
}
ORDER_RULES = [
    ("o_totalprice", M.ADD_MISSING_INDICATOR), ("mostly_missing", M.ADD_MISSING_INDICATOR),
    ("const_col", M.REMOVE_COLUMN),
]
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
LINE_ROLES = {
    "l_orderkey": M.ID, "l_partkey": M.IGNORE, "l_suppkey": M.IGNORE, "l_linenumber": M.IGNORE,
    "l_quantity": M.CONTINUOUS_NUMERIC, "l_extendedprice": M.TARGET, "l_discount": M.IGNORE,
    "l_tax": M.IGNORE, "l_returnflag": M.IGNORE, "l_linestatus": M.IGNORE, "l_shipdate": M.IGNORE,
}
DECIMALS = 6


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name] = function
        return function
    return register


def tidy(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Doubles rounded, lists joined, so that two engines print the same."""
    columns = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, decimals) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        columns.append(c.alias(f.name))
    return df.select(*columns)


# ---- inputs ------------------------------------------------------------------------------------

def customer_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("customer_code"), "c_mktsegment", "c_acctbal",
        (F.col("c_acctbal") > 0).alias("in_credit"))


def orders_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.infer_roles(P.stored_profile(orders_dirty(spark, sf_dir), ["o_orderkey"]))


def customer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.infer_roles(P.stored_profile(customer_coded(spark, sf_dir), ["c_custkey"]))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = S.drop_duplicates(orders_dirty(spark, sf_dir))
    return S.target_present(distinct, "o_orderstatus")


def orders_split(spark: SparkSession, sf_dir: str) -> S.Split:
    return S.split_rows(order_rows(spark, sf_dir), 0.2, 42, ["o_orderkey"], "o_orderstatus")


def part_split(spark: SparkSession, sf_dir: str) -> S.Split:
    return S.split_rows(table(spark, sf_dir, "part"), 0.2, 42, ["p_partkey"])


def orders_run(spark: SparkSession, sf_dir: str) -> pipeline.PreparationRun:
    return pipeline.run_supervised(orders_dirty(spark, sf_dir), ORDER_ROLES, M.CLASSIFICATION,
                                   None, ORDER_RULES, ["o_orderkey"])


def lines_run(spark: SparkSession, sf_dir: str) -> pipeline.PreparationRun:
    return pipeline.run_supervised(lineitem_reg(spark, sf_dir), LINE_ROLES, M.REGRESSION, None, (),
                                   LINE_KEY)


def fitted_orders(spark: SparkSession, sf_dir: str, columns: Sequence[str],
                  **knobs: object) -> tuple[DataFrame, fit.FittedState]:
    """Split orders and a state of `columns` fitted on their training part."""
    split = orders_split(spark, sf_dir)
    config = M.PipelineConfig(**knobs)
    state = fit.fit(split.part(S.TRAIN), ORDER_ROLES, columns, [], config)
    return split.rows, state


def transformed_orders(spark: SparkSession, sf_dir: str, columns: Sequence[str],
                       **knobs: object) -> DataFrame:
    rows, state = fitted_orders(spark, sf_dir, columns, **knobs)
    return tidy(X.transform(rows, state, keep=["o_orderkey", S.SPLIT]))


# ---- sources and sinks -------------------------------------------------------------------------

@query("csv_scan")
def csv_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("string"))
    path = new_path(spark, "csv")
    C.write_csv(orders, path, delimiter=";", bom=False)
    return C.read_csv(spark, path)


@query("csv_dialects")
def csv_dialects(spark, sf_dir):
    root = new_path(spark, "dialects")
    customer = table(spark, sf_dir, "customer")
    for name, delimiter in (("comma", ","), ("pipe", "|"), ("semicolon", ";"), ("tab", "\t")):
        C.write_csv(customer, f"{root}/{name}", delimiter=delimiter)
    found = dialects.csv_dialects(spark, root)
    return found.select(
        F.regexp_extract("path", r"/([a-z]+)/[^/]*$", 1).alias("dialect"), "encoding",
        "delimiter", F.array_join("header", "|").alias("header")).distinct()


@query("header_validate")
def header_validate(spark, sf_dir):
    root = new_path(spark, "headers")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    for name, second in (("good", "c_name"), ("blank", " "), ("repeated", "c_custkey ")):
        C.write_csv(customer.withColumnRenamed("c_name", second), f"{root}/{name}")
    problems = dialects.header_problems(dialects.csv_dialects(spark, root))
    folder = F.regexp_extract("path", r"/([a-z]+)/[^/]*$", 1)
    return problems.select(folder.alias("folder"), "problem").distinct()


@query("corrupt_rows")
def corrupt_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    customer = F.when(key % 103 == 0, "oops").otherwise(F.col("o_custkey").cast("string"))
    line = F.concat_ws(",", key, customer, "o_orderstatus", F.when(key % 101 == 0, "extra"))
    path = new_path(spark, "lines")
    table(spark, sf_dir, "orders").select(line.alias("line")).write.text(path)
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    reader = C.read_csv_with_rejects(spark, path, schema, header=False)
    return C.corrupt_rows(reader).select(F.col(C.CORRUPT).alias("line"))


@query("xlsx_ingest")
def xlsx_ingest(spark, sf_dir):
    path = new_path(spark, "workbooks")
    part = table(spark, sf_dir, "part")
    write_workbooks(part, F.floor(F.col("p_partkey") / 500), path)
    rows = materialize(xlsx.read_workbooks(spark, path), "cells")
    return xlsx.workbook_frame(rows, part.columns)


@query("parquet_roundtrip")
def parquet_roundtrip(spark, sf_dir):
    path = new_path(spark, "parquet")
    tables.write_parquet(orders_dirty(spark, sf_dir), path)
    return tables.read_parquet(spark, path)


@query("csv_bom_export")
def csv_bom_export(spark, sf_dir):
    path = new_path(spark, "bom")
    C.write_csv(table(spark, sf_dir, "part"), path)
    return C.read_csv(spark, path)


@query("state_json")
def state_json(spark, sf_dir):
    _, state = fitted_orders(spark, sf_dir, ["o_custkey", "o_totalprice", "o_orderpriority"])
    path = new_path(spark, "state")
    tables.write_json(state.to_dataframe(spark), path)
    stored = spark.read.schema(fit.STATE_SCHEMA).json(path)
    return _state_view(fit.FittedState.from_dataframe(stored).to_dataframe(spark))


@query("file_sha256")
def file_sha256(spark, sf_dir):
    found = tables.file_sha256(spark, sf_dir, "*.parquet")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size", "sha256")


@query("table_fingerprint")
def table_fingerprint(spark, sf_dir):
    return tables.table_fingerprint(orders_dirty(spark, sf_dir))


# ---- profiling ---------------------------------------------------------------------------------

@query("head_sample")
def head_sample(spark, sf_dir):
    sample, is_sampled = P.head_sample(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return sample.select("o_orderkey", "o_custkey", "o_totalprice").withColumn(
        "is_sampled", F.lit(is_sampled))


@query("schema_infer")
def schema_infer(spark, sf_dir):
    return P.schema_infer(table(spark, sf_dir, "lineitem")).select("column", "inferred_type")


@query("missing_stats")
def missing_stats(spark, sf_dir):
    return tidy(P.missing_stats(orders_dirty(spark, sf_dir)))


@query("unique_stats")
def unique_stats(spark, sf_dir):
    return P.unique_stats(orders_dirty(spark, sf_dir))


@query("unique_stats_lineitem")
def unique_stats_lineitem(spark, sf_dir):
    return P.unique_stats(lineitem_reg(spark, sf_dir))


@query("example_values")
def example_values(spark, sf_dir):
    return tidy(P.example_values(orders_dirty(spark, sf_dir), ["o_orderkey"]))


@query("preview_rows")
def preview_rows(spark, sf_dir):
    return P.preview_rows(orders_dirty(spark, sf_dir), ["o_orderkey"])


@query("column_profile")
def column_profile(spark, sf_dir):
    return tidy(P.column_profile(orders_dirty(spark, sf_dir), ["o_orderkey"]))


@query("column_profile_documents")
def column_profile_documents(spark, sf_dir):
    return tidy(P.column_profile(table(spark, sf_dir, "documents"), ["doc_id"])).drop("examples")


@query("dataset_profile")
def dataset_profile(spark, sf_dir):
    return P.dataset_profile(orders_dirty(spark, sf_dir), ["o_orderkey"])


@query("dataset_profile_sampled")
def dataset_profile_sampled(spark, sf_dir):
    return P.dataset_profile(table(spark, sf_dir, "orders"), ["o_orderkey"], M.SAMPLE_ROWS)


# ---- roles and quality --------------------------------------------------------------------------

@query("infer_roles")
def infer_roles(spark, sf_dir):
    documents = P.column_profile(table(spark, sf_dir, "documents"), ["doc_id"])
    return (
        orders_roles(spark, sf_dir).unionByName(customer_roles(spark, sf_dir))
        .unionByName(R.infer_roles(documents)).select("column", "inferred_type", "role")
    )


@query("confirm_roles")
def confirm_roles(spark, sf_dir):
    found = orders_roles(spark, sf_dir).select("column", "role")
    kept = found.where("column <> 'num_text'")
    again = found.where("column = 'const_col'")
    renamed = found.where("column = 'num_text'").select(
        F.concat("column", F.lit("_2")).alias("column"), "role")
    return R.role_violations(found, kept.unionByName(again).unionByName(renamed),
                             M.CLASSIFICATION)


def _dimension(name: str, dimension: str) -> None:
    @query(name)
    def scored(spark, sf_dir):
        return quality.quality_dimension(orders_roles(spark, sf_dir), M.CLASSIFICATION, dimension)


_dimension("q_completeness", quality.COMPLETENESS)
_dimension("q_validity", quality.VALIDITY)
_dimension("q_consistency", quality.CONSISTENCY)
_dimension("q_uniqueness", quality.UNIQUENESS)
_dimension("q_structure", quality.STRUCTURE)
_dimension("q_task_readiness", quality.READINESS)


@query("quality_report")
def quality_report(spark, sf_dir):
    return quality.quality_report(orders_roles(spark, sf_dir), M.CLASSIFICATION)


@query("quality_deductions")
def quality_deductions(spark, sf_dir):
    return quality.quality_deductions(orders_roles(spark, sf_dir), M.CLASSIFICATION).select(
        "dimension", "rule_id", "column", "points")


# ---- recommendations ------------------------------------------------------------------------------

def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommendations(orders_roles(spark, sf_dir), M.CLASSIFICATION)


def _brief(recs: DataFrame) -> DataFrame:
    return recs.select("id", "rule_id", "column", "severity", "risk", "confidence", "action",
                       "enabled")


def _rule(name: str, rule: str) -> None:
    @query(name)
    def found(spark, sf_dir):
        return _brief(_recs(spark, sf_dir).where(F.col("rule_id") == rule))


_rule("rec_target", recommend.TARGET_RULE)
_rule("rec_high_missing", recommend.HIGH_MISSING)
_rule("rec_missing_indicator", recommend.INDICATOR)
_rule("rec_constant", recommend.CONSTANT)
_rule("rec_high_cardinality", recommend.CARDINALITY)


@query("rec_exclude_id")
def rec_exclude_id(spark, sf_dir):
    recs = recommend.recommendations(customer_roles(spark, sf_dir), M.CLEANING)
    return _brief(recs.where(F.col("rule_id") == recommend.IDENTIFIER))


@query("rec_conflicts")
def rec_conflicts(spark, sf_dir):
    return tidy(_recs(spark, sf_dir).select("id", "conflicts_with"))


@query("rec_selection_check")
def rec_selection_check(spark, sf_dir):
    recs = materialize(_recs(spark, sf_dir), "recommendations")
    twice = recs.where(F.col("rule_id") == recommend.CONSTANT).select("id")
    unknown = recs.where(F.col("rule_id") == recommend.CARDINALITY).select(
        F.concat("id", F.lit("00")).alias("id"))
    selected = recs.select("id").unionByName(twice).unionByName(unknown)
    return recommend.selection_violations(recs, selected)


@query("rec_enablement")
def rec_enablement(spark, sf_dir):
    recs = _recs(spark, sf_dir)
    first = recommend.enable(recs).select(F.lit("first").alias("build"), "id", "enabled")
    previous = ["BD-MISSING-001:" + "mostly_missing".encode().hex(),
                "BD-MISSING-002:" + "o_totalprice".encode().hex()]
    later = recommend.enable(recs, previous).select(F.lit("later").alias("build"), "id", "enabled")
    return first.unionByName(later)


# ---- rows and splitting ---------------------------------------------------------------------------

@query("drop_duplicates")
def drop_duplicates(spark, sf_dir):
    return S.drop_duplicates(orders_dirty(spark, sf_dir))


@query("target_missing")
def target_missing(spark, sf_dir):
    return S.target_missing(S.drop_duplicates(orders_dirty(spark, sf_dir)), "o_orderstatus")


@query("target_present")
def target_present(spark, sf_dir):
    return order_rows(spark, sf_dir).select("o_orderkey", "o_orderstatus")


@query("split_preconditions")
def split_preconditions(spark, sf_dir):
    rare = F.when(F.col("o_orderkey") == 1, "rare").otherwise(F.col("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", rare)
    config = M.PipelineConfig()
    by_class = S.split_preconditions(S.class_counts(orders, "o_orderstatus"), M.CLASSIFICATION,
                                     config)
    priced = orders_dirty(spark, sf_dir)
    rejected = S.strict_numeric(priced, ["num_text"]).head()["rejected"]
    by_number = S.split_preconditions(S.class_counts(priced, None), M.REGRESSION, config, rejected)
    return by_class.unionByName(by_number)


@query("split_ties")
def split_ties(spark, sf_dir):
    """Rows that tie on their key and differ in microseconds, each of them twice."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "timestampadd(MICROSECOND, o_orderkey % 3, o_orderdate) AS placed_at")
    split = S.split_rows(orders.unionAll(orders), 0.2, 7, ["o_custkey"])
    parts = split.rows.groupBy("o_custkey", "placed_at").agg(F.count("*").alias("n"))
    test = split.rows.where("split = 'test'").count()
    return parts.withColumn("test_rows", F.lit(test).cast("bigint"))


@query("split_random")
def split_random(spark, sf_dir):
    return S.split_rows(table(spark, sf_dir, "events"), 0.2, 42, ["event_id"]).rows.select(
        "event_id", S.SPLIT)


@query("split_stratified")
def split_stratified(spark, sf_dir):
    return orders_split(spark, sf_dir).rows.select("o_orderkey", "o_orderstatus", S.SPLIT)


@query("split_stratified_labels")
def split_stratified_labels(spark, sf_dir):
    split = S.split_rows(labels_cls(spark, sf_dir), 0.3, 7, ["doc_id"], "quality")
    return split.rows.select("doc_id", "quality", S.SPLIT)


@query("split_counts")
def split_counts(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    return S.split_counts(run.split.rows, run.target_missing, run.stratified)


@query("strict_numeric")
def strict_numeric(spark, sf_dir):
    return S.strict_numeric(orders_dirty(spark, sf_dir),
                            ["num_text", "o_totalprice", "o_orderpriority"])


@query("schema_drift")
def schema_drift(spark, sf_dir):
    found = table(spark, sf_dir, "orders").columns
    drift = S.schema_drift(found, orders_dirty(spark, sf_dir).columns)
    return small_table(spark, drift, "problem string, column string")


# ---- fit and transform -----------------------------------------------------------------------------

@query("select_features")
def select_features(spark, sf_dir):
    profile = R.with_roles(
        P.stored_profile(orders_dirty(spark, sf_dir), ["o_orderkey"]), ORDER_ROLES)
    recs = recommend.enable(recommend.recommendations(profile, M.CLASSIFICATION))
    return fit.feature_plan(profile, recs).drop("ordinal")


@query("impute_mean")
def impute_mean(spark, sf_dir):
    return transformed_orders(spark, sf_dir, ["o_totalprice"], numeric_imputation="mean",
                              scaling="none")


@query("impute_median")
def impute_median(spark, sf_dir):
    return transformed_orders(spark, sf_dir, ["o_totalprice"], scaling="none")


@query("drop_constant_numeric")
def drop_constant_numeric(spark, sf_dir):
    rows = orders_split(spark, sf_dir).part(S.TRAIN).select(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7.0)).alias("const_num"),
        F.lit(None).cast("double").alias("empty_num"))
    columns = rows.columns
    state = fit.fit(rows, dict.fromkeys(columns, M.CONTINUOUS_NUMERIC), columns, [],
                    M.PipelineConfig())
    return state.to_dataframe(spark).select("column", "dropped", "fill_num")


@query("scale_standard")
def scale_standard(spark, sf_dir):
    return transformed_orders(spark, sf_dir, ["o_custkey", "o_totalprice"])


@query("scale_minmax")
def scale_minmax(spark, sf_dir):
    return transformed_orders(spark, sf_dir, ["o_custkey", "o_totalprice"], scaling="minmax")


@query("scale_none")
def scale_none(spark, sf_dir):
    return transformed_orders(spark, sf_dir, ["o_custkey"], scaling="none")


@query("normalize_category")
def normalize(spark, sf_dir):
    return orders_dirty(spark, sf_dir).select(
        "o_orderkey", normalize_category(F.col("o_orderpriority")).alias("o_orderpriority"))


def _filled(spark: SparkSession, sf_dir: str, imputation: str) -> DataFrame:
    rows, state = fitted_orders(spark, sf_dir, ["o_orderpriority", "mostly_missing"],
                                categorical_imputation=imputation, drop_constant_features=False)
    fills = {c.column: c.fill_str for c in state.columns}
    return rows.select("o_orderkey", S.SPLIT, *[
        F.coalesce(normalize_category(F.col(c)), F.lit(v)).alias(c) for c, v in fills.items()])


@query("impute_mode")
def impute_mode(spark, sf_dir):
    return _filled(spark, sf_dir, "most_frequent")


@query("impute_missing_category")
def impute_missing_category(spark, sf_dir):
    return _filled(spark, sf_dir, "missing_category")


@query("vocabulary")
def vocabulary(spark, sf_dir):
    train = part_split(spark, sf_dir).part(S.TRAIN)
    return fit.vocabulary(fit.category_counts(train, ["p_name", "p_brand", "p_type"]), 50)


@query("drop_constant_category")
def drop_constant_category(spark, sf_dir):
    _, state = fitted_orders(spark, sf_dir, ["o_orderpriority", "const_col", "mostly_missing"])
    return state.to_dataframe(spark).select("column", "dropped", "fill_str")


@query("one_hot")
def one_hot(spark, sf_dir):
    return transformed_orders(spark, sf_dir, ["o_orderpriority"])


def _part_state(split: S.Split) -> fit.FittedState:
    return fit.fit(split.part(S.TRAIN), {"p_name": M.NOMINAL_CATEGORY, "p_type": M.NOMINAL_CATEGORY},
                   ["p_name", "p_type"], [], M.PipelineConfig())


@query("unknown_bucket")
def unknown_bucket(spark, sf_dir):
    split = part_split(spark, sf_dir)
    rows = X.transform(split.rows, _part_state(split), keep=["p_partkey", S.SPLIT])
    return rows.select("p_partkey", S.SPLIT, "p_name__unknown", "p_type__unknown")


@query("unknown_counts")
def unknown_counts(spark, sf_dir):
    split = part_split(spark, sf_dir)
    state = _part_state(split)
    return X.unknown_counts(X.transform(split.part(S.TEST), state), state)


@query("missing_indicator")
def missing_indicator(spark, sf_dir):
    split = orders_split(spark, sf_dir)
    columns = ["o_totalprice", "mostly_missing"]
    state = fit.fit(split.part(S.TRAIN), ORDER_ROLES, columns, columns, M.PipelineConfig())
    rows = X.transform(split.rows, state, keep=["o_orderkey", S.SPLIT])
    return rows.select("o_orderkey", S.SPLIT, "o_totalprice__is_missing",
                       "mostly_missing__is_missing")


def _state_view(state: DataFrame) -> DataFrame:
    return tidy(state, 5).select(
        "column", "ordinal", "kind", "imputation", "fill_num", "fill_str", "scaling", "center",
        "scale", "categories", "truncated", "unknown_output", "dropped", "missing_indicator")


@query("fitted_state")
def fitted_state(spark, sf_dir):
    return _state_view(orders_run(spark, sf_dir).state.to_dataframe(spark))


@query("output_schema")
def output_schema(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    names = list(enumerate(X.output_schema(run.state, run.target)))
    return small_table(spark, names, "position int, name string")


@query("supervised_pipeline")
def supervised_pipeline(spark, sf_dir):
    return tidy(orders_run(spark, sf_dir).transformed())


@query("supervised_pipeline_regression")
def supervised_pipeline_regression(spark, sf_dir):
    return tidy(lines_run(spark, sf_dir).transformed())


@query("cleaning_pipeline")
def cleaning_pipeline(spark, sf_dir):
    roles = {**ORDER_ROLES, "o_orderstatus": M.NOMINAL_CATEGORY}
    run = pipeline.run_cleaning(orders_dirty(spark, sf_dir), roles, None, ORDER_RULES)
    return tidy(run.processed)


@query("transform_stream")
def transform_stream(spark, sf_dir):
    events = events_holed(spark, sf_dir)
    roles = {"value": M.CONTINUOUS_NUMERIC, "event_type": M.NOMINAL_CATEGORY}
    state = fit.fit(events, roles, list(roles), ["value"], M.PipelineConfig())
    source, sink, marks = (new_path(spark, x) for x in ("source", "sink", "marks"))
    events.write.parquet(source)
    stream = apply.transform_stream(spark, source, events.schema, state, keep=["event_id"])
    apply.write_available(stream, sink, marks).awaitTermination()
    return tidy(spark.read.parquet(sink))


# ---- evaluation ---------------------------------------------------------------------------------------

@query("same_split_check")
def same_split_check(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    parts = []
    for part in (S.TRAIN, S.TEST):
        raw = run.split.part(part)
        # Some rows are lost and some get another target on the way.
        key, target = F.col("o_orderkey"), F.col(run.target)
        processed = X.transform(raw, run.state, run.target, keep=["o_orderkey"]).where(
            key % 101 != 1).withColumn(run.target, F.when(key % 103 == 2, "F").otherwise(target))
        off = evaluate.same_split_check(raw, processed, ["o_orderkey", run.target])
        parts.append(off.agg(F.count(F.lit(1)).alias("mismatches")).select(
            F.lit(part).alias("part"), F.lit(True).alias("compared"), "mismatches"))
    return parts[0].unionByName(parts[1])


@query("baseline_features")
def baseline_features(spark, sf_dir):
    split = orders_split(spark, sf_dir)
    features = ["o_totalprice", "o_orderpriority", "mostly_missing"]
    both = evaluate.baseline_features(split.part(S.TRAIN), split.part(S.TEST), ORDER_ROLES,
                                      features, "o_orderstatus")
    parts = [
        df.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
        .groupBy("feature").agg(F.sum("value").alias("total")).withColumn("part", F.lit(name))
        for df, name in zip(both, (S.TRAIN, S.TEST))
    ]
    return tidy(parts[0].unionByName(parts[1]), 2)


@query("fit_logistic")
def fit_logistic(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    train, test = (evaluate.complete_features(run.frames[p], run.outputs, run.target)
                   for p in (S.TRAIN, S.TEST))
    scored = evaluate.fit_logistic(train, test, run.split.n - run.split.n_test)
    return metrics.confusion(scored)


@query("classification_metrics")
def classification_metrics(spark, sf_dir):
    price = F.col("o_totalprice")
    guess = F.when(price < 150000, "F").when(price < 380000, "O").otherwise("X")
    scored = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"),
                                                   guess.alias("prediction"))
    return tidy(metrics.classification_metrics(scored))


@query("fit_ridge")
def fit_ridge(spark, sf_dir):
    run = lines_run(spark, sf_dir)
    train, test = (evaluate.complete_features(run.frames[p], run.outputs, run.target)
                   for p in (S.TRAIN, S.TEST))
    return tidy(evaluate.fit_ridge(train, test, run.split.n - run.split.n_test), 3)


@query("regression_metrics")
def regression_metrics(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1500 + F.col("l_discount")).alias("prediction"))
    return tidy(metrics.regression_metrics(scored), 4)


@query("scheme_comparison")
def scheme_comparison(spark, sf_dir):
    return tidy(evaluation.compare_schemes(lines_run(spark, sf_dir)).drop("delta"), 4)


@query("scheme_comparison_classification")
def scheme_comparison_classification(spark, sf_dir):
    return evaluation.compare_schemes(orders_run(spark, sf_dir))


@query("numeric_target")
def numeric_target(spark, sf_dir):
    dirty = orders_dirty(spark, sf_dir)
    number = strict_double(F.col("num_text"), dirty.schema["num_text"].dataType)
    rows = pipeline.numeric_target(dirty.where(number.isNotNull()), "num_text")
    return tidy(rows.select("o_orderkey", "num_text"))


@query("evaluation_off")
def evaluation_off(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    scores = evaluation.evaluate_run(run, evaluation.OFF)
    paths = {part: new_path(spark, part) for part in (S.TRAIN, S.TEST)}
    for part, path in paths.items():
        C.write_csv(run.frames[part], path)
    counts = [
        spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(part).alias("part"), "rows", F.lit(scores is not None).alias("scored"))
        for part, path in paths.items()
    ]
    return counts[0].unionByName(counts[1])


# ---- records and catalog ---------------------------------------------------------------------------------

@query("run_manifest")
def run_manifest(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    source = tables.table_fingerprint(orders_dirty(spark, sf_dir)).head()["fingerprint"]
    row = manifest.run_manifest(run, spark, "p1", "r1", str(source), ["a"])
    path = new_path(spark, "manifest")
    manifest.append_manifest(row, path)
    return spark.read.parquet(path).select(
        "run_id", "source_fingerprint", "task", "target_column", "train_rows", "test_rows",
        "target_missing_rows", "stratified", F.size("output_feature_columns").alias("outputs"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("upstream"))


@query("latest_run")
def latest_run(spark, sf_dir):
    return manifest.latest_run(_runs(spark, sf_dir))


@query("stale_runs")
def stale_runs(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("upstream"))
    return manifest.stale_runs(_runs(spark, sf_dir), current)


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    task = F.element_at(F.array(*[F.lit(t) for t in M.TASKS]), (key % 4 + 1).cast("int"))
    status = F.when(key % 3 == 0, "processing").otherwise("ready")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit(".CSV")).alias("source_filename"), task.alias("task_type"),
        status.alias("status"), (F.col("p_size").cast("bigint") * 1024).alias("source_size"),
        (key * 7919 % 100003).alias("created_at"))


@query("catalog_list")
def catalog_list(spark, sf_dir):
    return catalog.catalog_list(_projects(spark, sf_dir)).select("id", "name", "created_at")


@query("catalog_search")
def catalog_search(spark, sf_dir):
    projects = _projects(spark, sf_dir)
    found = [catalog.catalog_search(projects, q).select(F.lit(i).alias("search"), "id")
             for i, q in enumerate(("RED", "brand#2.csv", "分类"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("catalog_summary")
def catalog_summary(spark, sf_dir):
    return catalog.catalog_summary(_projects(spark, sf_dir))


@query("run_summary")
def run_summary(spark, sf_dir):
    run = orders_run(spark, sf_dir)
    profile = R.with_roles(
        P.stored_profile(orders_dirty(spark, sf_dir), ["o_orderkey"]), ORDER_ROLES)
    counts = run.split.rows.groupBy(F.col(S.SPLIT).alias("part")).agg(
        F.count(F.lit(1)).alias("rows"))
    return report.run_summary(
        counts, quality.quality_report(profile, M.CLASSIFICATION),
        recommend.recommendations(profile, M.CLASSIFICATION))
