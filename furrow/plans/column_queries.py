"""Queries of categories, checks and derived columns, in the same registry as the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import categories, checks, derive, fit
from furrow.operators import split as S
from furrow.plans.dirty import events_holed, lineitem_reg, orders_dirty, table
from furrow.plans.queries import LINE_KEY, orders_split, part_split, query, tidy
from furrow.session import new_path
from furrow.streaming import profile as stream

RULES = [
    checks.Rule("status given", checks.NOT_NULL, ["o_orderstatus"]),
    checks.Rule("price in range", checks.RANGE, ["o_totalprice"], 20_000.0, 300_000.0),
    checks.Rule("price is a number", checks.RANGE, ["num_text"]),
    checks.Rule("known priority", checks.IN_SET, ["o_orderpriority"],
                values=["1-URGENT", "2-HIGH", "3-MEDIUM"]),
    checks.Rule("form of priority", checks.PATTERN, ["o_orderpriority"], pattern="^[1-5]-[A-Z ]+$"),
    checks.Rule("in the nineties", checks.DATES, ["o_orderdate"], "1992-01-01", "1997-06-30"),
    checks.Rule("one row a key", checks.UNIQUE, ["o_orderkey"]),
    checks.Rule("one row a customer and day", checks.UNIQUE, ["o_custkey", "o_orderdate"]),
]


# ---- categories -----------------------------------------------------------------------------------

def sparse_events(spark, sf_dir):
    """Events with a column that is nearly always the same, and one that is nearly always empty."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").withColumns({
        "channel": F.when(key % 211 != 3, "web").otherwise(F.col("event_type")),
        "note": F.when(key % 499 == 1, F.col("event_type")),
        "half": F.when(key % 2 == 0, "even"),
    })


@query("near_constant")
def near_constant(spark, sf_dir):
    return tidy(categories.near_constant(
        sparse_events(spark, sf_dir), ["event_type", "channel", "note", "half"]))


@query("rare_categories")
def rare_categories(spark, sf_dir):
    return tidy(categories.rare_categories(
        table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate", "l_returnflag"], 0.01, 20))


@query("merge_rare")
def merge_rare(spark, sf_dir):
    """Part types as training has them often enough, with a limit that some of them miss."""
    split = part_split(spark, sf_dir)
    state = categories.fit_common(split.part(S.TRAIN), ["p_type", "p_size", "p_brand"], 0.02, 5)
    return categories.merge_rare(split.rows, state).select(
        "p_partkey", "p_type", "p_size", "p_brand", S.SPLIT)


@query("class_weights")
def class_weights(spark, sf_dir):
    return tidy(categories.class_weights(orders_dirty(spark, sf_dir), "o_orderstatus"))


@query("class_imbalance")
def class_imbalance(spark, sf_dir):
    return tidy(categories.class_imbalance(orders_dirty(spark, sf_dir), "o_orderstatus"))


def _resampled(spark, sf_dir, rows_per_class):
    train = orders_split(spark, sf_dir).part(S.TRAIN)
    return categories.resample(train, "o_orderstatus", ["o_orderkey"], rows_per_class).select(
        "o_orderkey", "o_orderstatus", categories.COPY)


@query("oversample")
def oversample(spark, sf_dir):
    return _resampled(spark, sf_dir, "most")


@query("undersample")
def undersample(spark, sf_dir):
    return _resampled(spark, sf_dir, "least")


@query("encode_ordinal")
def encode_ordinal(spark, sf_dir):
    order = ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return orders_dirty(spark, sf_dir).select("o_orderkey", categories.encode_ordinal(
        F.col("o_orderpriority"), order).alias("priority"))


@query("encode_binary")
def encode_binary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    values = categories.fit_binary(lines, "l_linestatus")
    return lines.select(*LINE_KEY, categories.encode_binary(F.col("l_linestatus"), values).alias(
        "status"))


@query("encode_frequency")
def encode_frequency(spark, sf_dir):
    split = orders_split(spark, sf_dir)
    columns = {"o_custkey": "customer_share", "o_orderpriority": "priority_share"}
    known = categories.fit_frequencies(split.part(S.TRAIN), list(columns))
    return tidy(categories.encode_frequency(split.rows, known, columns).select(
        "o_orderkey", S.SPLIT, *columns.values()))


# ---- checks ---------------------------------------------------------------------------------------

@query("duplicates_by_key")
def duplicates_by_key(spark, sf_dir):
    return checks.duplicates_by_key(orders_dirty(spark, sf_dir), ["o_custkey", "o_orderpriority"])


@query("target_conflicts")
def target_conflicts(spark, sf_dir):
    return checks.target_conflicts(
        orders_dirty(spark, sf_dir), ["o_custkey", "mostly_missing"], "o_orderstatus")


@query("validate_rules")
def validate_rules(spark, sf_dir):
    return checks.validate_rules(orders_dirty(spark, sf_dir), RULES)


@query("rule_violations")
def rule_violations(spark, sf_dir):
    found = checks.violations(orders_dirty(spark, sf_dir), RULES)
    return found.select("o_orderkey", F.array_join("broken_rules", "; ").alias("broken_rules"))


@query("resource_estimate")
def resource_estimate(spark, sf_dir):
    split = orders_split(spark, sf_dir)
    roles = {"o_totalprice": M.CONTINUOUS_NUMERIC, "o_orderpriority": M.NOMINAL_CATEGORY,
             "mostly_missing": M.NOMINAL_CATEGORY}
    state = fit.fit(split.part(S.TRAIN), roles, list(roles), ["o_totalprice"], M.PipelineConfig(
        categorical_imputation="missing_category"))
    return checks.resource_estimate(split.rows, state)


# ---- derived columns --------------------------------------------------------------------------------

def written_numbers(spark, sf_dir):
    """Prices, shares and days as people write them, with some that are no numbers."""
    key, price = F.col("l_orderkey"), F.col("l_extendedprice").cast("decimal(12,2)")
    grouped = F.format_number(price, 2)
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        F.when(key % 11 == 0, F.concat(F.lit("$"), grouped))
        .when(key % 11 == 1, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(key % 11 == 2, F.concat(price.cast("string"), F.lit(" EUR")))
        .when(key % 11 == 3, F.concat(F.lit("-€ "), price.cast("string")))
        .when(key % 11 == 4, F.replace(price.cast("string"), F.lit("."), F.lit(",")))
        .when(key % 11 == 5, F.concat(price.cast("string"), F.lit("e2")))
        .when(key % 11 == 6, F.lit("n/a")).otherwise(price.cast("string")).alias("price"),
        F.concat((F.col("l_discount") * 100).cast("decimal(5,1)").cast("string"),
                 F.when(key % 3 == 0, " %").otherwise("%")).alias("share"),
        F.when(key % 7 != 0, F.datediff("l_shipdate", F.lit("1899-12-30")).cast("string"))
        .otherwise(F.col("l_linenumber").cast("string")).alias("day"))


@query("parse_numbers")
def parse_numbers(spark, sf_dir):
    lines = written_numbers(spark, sf_dir)
    return tidy(lines.select(
        *LINE_KEY, derive.parse_number(F.col("price")).alias("price"),
        derive.parse_number(F.col("share")).alias("share"),
        derive.parse_serial_date(F.col("day")).cast("timestamp_ntz").alias("day")))


@query("parse_report")
def parse_report(spark, sf_dir):
    return derive.parse_report(written_numbers(spark, sf_dir), ["price", "share", "day"])


@query("date_features")
def date_features(spark, sf_dir):
    return derive.date_features(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"])


@query("ratio_diff_sum_product")
def ratio_diff_sum_product(spark, sf_dir):
    lines = lineitem_reg(spark, sf_dir).select(*LINE_KEY, "l_quantity", "l_tax", "l_discount")
    return tidy(derive.combine(lines, {
        "total": ("l_tax", "sum", "l_discount"), "gap": ("l_quantity", "difference", "l_tax"),
        "taxed": ("l_quantity", "product", "l_tax"), "rate": ("l_quantity", "ratio", "l_discount"),
    }).select(*LINE_KEY, "total", "gap", "taxed", "rate"))


def _scaled(spark, sf_dir):
    split = S.split_rows(events_holed(spark, sf_dir).select(
        "event_id", "value", F.col("user_id").cast("double").alias("user_number"),
        (F.col("value") * F.col("value")).alias("squared")), 0.2, 42, ["event_id"])
    return split, derive.fit_scales(split.part(S.TRAIN), ["value", "squared"], {"squared": 4},
                                    {"value": 5, "user_number": 3})


@query("scale_robust")
def scale_robust(spark, sf_dir):
    split, state = _scaled(spark, sf_dir)
    return tidy(derive.scale_robust(split.rows, state).select("event_id", "value", "squared", S.SPLIT))


@query("log_transform")
def log_transform(spark, sf_dir):
    events = events_holed(spark, sf_dir).select("event_id", "value", (-F.col("value")).alias("negative"))
    return tidy(derive.log_transform(events, ["value", "negative"]))


@query("binning")
def binning(spark, sf_dir):
    split, state = _scaled(spark, sf_dir)
    return derive.bin_numbers(split.rows, state)


# ---- streams ----------------------------------------------------------------------------------------

@query("stream_profile")
def stream_profile(spark, sf_dir):
    """Events in five files, some of them twice, one file a batch; the watermark spans all of them."""
    events = events_holed(spark, sf_dir)
    source, parts, marks = (new_path(spark, x) for x in ("source", "profile", "marks"))
    events.unionByName(events.where("event_id % 20 = 0")).repartition(5).write.parquet(source)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(source)
    columns = ["event_id", "user_id", "event_type", "value"]
    stream.profile_stream(arriving, columns, parts, marks, "event_id", "ts",
                          "36500 days").awaitTermination()
    return tidy(stream.stream_profile(spark, parts).drop("about_distinct"))
