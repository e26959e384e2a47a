"""Queries of the planned feature operators, in the same registry as the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import (
    chained, dependence, gram, neighbours, ordered_split, outliers, power, spellings,
)
from furrow.operators import split as S
from furrow.operators import target_encoding as E
from furrow.operators.fit import numeric_facts
from furrow.plans.dirty import events_holed, lineitem_reg, orders_dirty, table
from furrow.plans.queries import LINE_KEY, orders_split, part_split, query, tidy
from furrow.session import small_table

WIDE_BINNED = ["l_extendedprice", "l_quantity", "price_again"]


def _encoded(split, columns, target, key, positive=None):
    train = split.part(S.TRAIN)
    fitted = E.fit_target_encoding(train, columns, target, key, positive)
    kept = [*key, S.SPLIT, *[c + E.SUFFIX for c in columns]]
    both = E.encode_training(train, fitted).withColumn(S.SPLIT, F.lit(S.TRAIN)).select(*kept)
    return tidy(both.unionByName(E.encode_others(split.part(S.TEST), fitted).withColumn(
        S.SPLIT, F.lit(S.TEST)).select(*kept)))


@query("target_encoding")
def target_encoding(spark, sf_dir):
    return _encoded(orders_split(spark, sf_dir), ["o_orderpriority", "o_custkey", "mostly_missing"],
                    "o_orderstatus", ["o_orderkey"], "F")


@query("target_encoding_regression")
def target_encoding_regression(spark, sf_dir):
    return _encoded(part_split(spark, sf_dir), ["p_brand", "p_type", "p_size"], "p_retailprice",
                    ["p_partkey"])


def part_names(spark, sf_dir):
    """Names of parts with slips: a letter left out, two changed places, one doubled, capitals."""
    name, key = F.col("p_name"), F.col("p_partkey")
    long_name = F.concat(name, F.lit(" of the finest "), "p_type", F.lit(" make"))

    def slipped(text):
        return (
            F.when(key % 23 == 0, F.concat(F.substring(text, 1, 3), F.expr(
                f"substring({_sql(text)}, 5)")))
            .when(key % 29 == 0, F.concat(F.substring(text, 2, 1), F.substring(text, 1, 1), F.expr(
                f"substring({_sql(text)}, 3)")))
            .when(key % 31 == 0, F.concat(text, F.lit("e"))).when(key % 37 == 0, F.upper(text))
            .otherwise(text))

    def _sql(text):
        return "name" if text is plain else "long_name"

    parts = table(spark, sf_dir, "part").withColumn("name", name).withColumn("long_name", long_name)
    plain, full = F.col("name"), F.col("long_name")
    return parts.select(F.explode(F.array(slipped(plain), slipped(full))).alias("name"))


@query("case_variants")
def case_variants(spark, sf_dir):
    return spellings.case_variants(spellings.value_counts(part_names(spark, sf_dir), "name"))


@query("near_spellings")
def near_spellings(spark, sf_dir):
    return spellings.near_spellings(spellings.value_counts(part_names(spark, sf_dir), "name"))


def wide_lines(spark, sf_dir):
    """Lines with copies of columns under other names, and one that differs in a few rows."""
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").withColumns({
        "quantity_again": quantity, "price_again": F.col("l_extendedprice"),
        "date_again": F.col("l_shipdate"),
        "nearly_quantity": F.when(F.col("l_orderkey") % 1000 != 7, quantity),
    })


@query("duplicate_columns")
def duplicate_columns(spark, sf_dir):
    return dependence.duplicate_columns(wide_lines(spark, sf_dir))


@query("mutual_information")
def mutual_information(spark, sf_dir):
    return tidy(dependence.mutual_information(wide_lines(spark, sf_dir), binned=WIDE_BINNED), 5)


@query("knn_impute")
def knn_impute(spark, sf_dir):
    """Holes in lines filled from the training part; approximate, so without SQL."""
    lines = lineitem_reg(spark, sf_dir).withColumn("l_returnflag", F.when(
        F.col("l_partkey") % 17 != 0, F.col("l_returnflag")))
    split = S.split_rows(lines, 0.2, 42, LINE_KEY)
    model = neighbours.fit_neighbours(
        split.part(S.TRAIN), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"])
    return tidy(neighbours.impute(split.rows, model))


# ---- correlation and components -----------------------------------------------------------------

RELATED = ["l_quantity", "quantity_again", "l_extendedprice", "l_discount", "discount_again", "l_tax",
           "l_partkey", "l_suppkey", "nearly_quantity"]


def related_lines(spark, sf_dir):
    """Lines with holes, and columns that follow others closely."""
    quantity = F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").withColumns({
        "l_quantity": quantity, "quantity_again": F.col("l_quantity") * -2 + 7,
        "discount_again": F.col("l_discount") + F.col("l_tax") / 4,
        "nearly_quantity": F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity") + F.col("l_tax")),
    })


@query("correlation")
def correlation(spark, sf_dir):
    return tidy(gram.correlations(related_lines(spark, sf_dir), RELATED, block=4))


@query("high_correlation")
def high_correlation(spark, sf_dir):
    return tidy(gram.high_correlations(related_lines(spark, sf_dir), RELATED, 0.9))


@query("pca")
def pca(spark, sf_dir):
    fitted = gram.fit_components(related_lines(spark, sf_dir), RELATED[:6], 2)
    return tidy(fitted.table(spark))


@query("iterative_impute")
def iterative_impute(spark, sf_dir):
    """Holes in related columns filled by models of the training part; compared with a dense version
    in the tests, so without SQL."""
    split = S.split_rows(related_lines(spark, sf_dir), 0.2, 42, LINE_KEY)
    state = chained.fit_chained(split.part(S.TRAIN), RELATED)
    return tidy(chained.impute_chained(split.rows, state), 4)


# ---- power transformation -----------------------------------------------------------------------

POWER_COLUMNS = ["l_extendedprice", "l_quantity", "l_tax", "balance"]
POWERS = [-2.0, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0]


def powered_lines(spark, sf_dir):
    return lineitem_reg(spark, sf_dir).withColumn(
        "balance", F.col("l_extendedprice") / 1000 - F.col("l_quantity"))


@query("yeo_johnson_likelihood")
def yeo_johnson_likelihood(spark, sf_dir):
    """The likelihood of a grid of exponents per row, for columns of one sign and of both."""
    lines = powered_lines(spark, sf_dir)
    facts = numeric_facts(lines, POWER_COLUMNS, median=False)
    found = power.log_likelihoods(lines, dict.fromkeys(POWER_COLUMNS, POWERS), facts)
    sizes = F.create_map(*[F.lit(x) for c in POWER_COLUMNS for x in (c, facts[c]["present"])])
    return tidy(found.withColumn("log_likelihood", F.col("log_likelihood") / sizes[F.col("column")]))


@query("yeo_johnson")
def yeo_johnson(spark, sf_dir):
    """Lines transformed by exponents of the training part; the search has no SQL."""
    split = S.split_rows(powered_lines(spark, sf_dir), 0.2, 42, LINE_KEY)
    state = power.fit_yeo_johnson(split.part(S.TRAIN), POWER_COLUMNS)
    return tidy(power.apply_yeo_johnson(split.rows, state), 3)


# ---- splits by time and group -------------------------------------------------------------------

@query("split_time")
def split_time(spark, sf_dir):
    """Lines by shipping date; many share the date of the cut."""
    lines = S.drop_duplicates(table(spark, sf_dir, "lineitem"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ordered_split.split_time(lines, "l_shipdate", 0.2, 42, key).rows.select(
        *LINE_KEY, S.SPLIT)


@query("split_time_events")
def split_time_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return ordered_split.split_time(events, "ts", 0.15, 42, ["event_id"]).rows.select(
        "event_id", "ts", S.SPLIT)


@query("split_group")
def split_group(spark, sf_dir):
    return ordered_split.split_group(orders_dirty(spark, sf_dir), "o_custkey", 0.2).rows.select(
        "o_orderkey", "o_custkey", S.SPLIT)


@query("split_group_pairs")
def split_group_pairs(spark, sf_dir):
    """Few groups, of two columns, one with holes: the cut falls far from the quota."""
    return ordered_split.split_group(orders_dirty(spark, sf_dir), [
        "o_orderstatus", "o_orderpriority"], 0.3, 7).rows.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", S.SPLIT)


# ---- outliers -----------------------------------------------------------------------------------

SPREAD = ["value", "squared", "tied", "amount"]


def spread_events(spark, sf_dir):
    """Events with holes, a column of few values, and amounts with slips of the decimal point."""
    value, key = F.col("value"), F.col("event_id")
    return events_holed(spark, sf_dir).select(
        "event_id", "value", (value * value).alias("squared"),
        F.floor(value / 10).cast("long").alias("tied"),
        F.when(key % 41 == 3, value * 100).when(key % 59 == 5, -value).otherwise(
            value).alias("amount"))


@query("quantiles")
def quantiles(spark, sf_dir):
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    found = outliers.exact_quantiles(spread_events(spark, sf_dir), SPREAD, shares)
    return tidy(small_table(spark, [
        (c, s, q) for c, line in found.items() for s, q in zip(shares, line)],
        "column string, share double, quantile double"))


def _fitted_spread(spark, sf_dir):
    split = S.split_rows(spread_events(spark, sf_dir), 0.2, 42, ["event_id"])
    return split, outliers.fit_outliers(split.part(S.TRAIN), SPREAD)


@query("outliers_iqr")
def outliers_iqr(spark, sf_dir):
    split, state = _fitted_spread(spark, sf_dir)
    return tidy(outliers.outlier_report(split.rows, state))


def _outlier_action(action):
    def run(spark, sf_dir):
        split, state = _fitted_spread(spark, sf_dir)
        return tidy(outliers.treat_outliers(split.rows, state, dict.fromkeys(SPREAD, action)))
    return run


for _action in outliers.ACTIONS:
    query(f"outliers_{_action}")(_outlier_action(_action))
