"""Duplicates, missing targets, and an exact, reproducible train/test split.

The split is a cut through pseudo-random row tokens (a hash of seed and key): in each class the
`quota` smallest tokens are test rows. The cut is found by counting tokens per prefix and
following the one prefix that holds it, so no class is ever sorted or gathered; afterwards being
a test row is a comparison inside a projection. Any partitioning gives the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import keyed_token, quoted, rejected_number, whole_row_token
from furrow.session import materialize

SPLIT, TRAIN, TEST = "split", "train", "test"
TOKEN, CLASS = "_token", "_class"
TOKEN_WIDTH = 32
PREFIX_STEP = 3
# Tokens per class that one task may rank; a larger class is first narrowed by prefix.
RANKED_ROWS = 100_000
# Copies of one row that one task writes.
COPIES_PER_TASK = 1_000_000


# ---- rows ---------------------------------------------------------------------------------

def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row for every set of equal rows, nulls being equal."""
    return df.dropDuplicates()


def target_missing(df: DataFrame, target: str) -> DataFrame:
    return df.where(quoted(target).isNull())


def target_present(df: DataFrame, target: str) -> DataFrame:
    return df.where(quoted(target).isNotNull())


def schema_drift(found: Sequence[str], confirmed: Sequence[str]) -> list[tuple[str, str]]:
    """(problem, column) pairs where a source no longer has the confirmed columns."""
    gone = [("missing_column", c) for c in sorted(set(confirmed) - set(found))]
    new = [("unexpected_column", c) for c in sorted(set(found) - set(confirmed))]
    return gone + new


def strict_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rejected): how many present values of each column are no numbers; one pass."""
    types = {f.name: f.dataType for f in df.schema}
    counts = df.agg(*[
        F.coalesce(F.sum(rejected_number(quoted(c), types[c]).cast("bigint")), F.lit(0))
        .alias(f"_{i}") for i, c in enumerate(columns)
    ])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("rejected"))
        for i, c in enumerate(columns)
    ])
    return counts.select(F.inline(cells))


# ---- preconditions and quotas ---------------------------------------------------------------

def class_counts(df: DataFrame, target: str | None) -> DataFrame:
    """(class, rows); without a target the whole table is one class."""
    return df.groupBy(_class_of(target).alias(CLASS)).agg(F.count(F.lit(1)).alias("rows"))


def test_rows(n: int, test_size: float) -> int:
    return math.ceil(n * test_size)


def split_preconditions(classes: DataFrame, task: str, config: M.PipelineConfig,
                        rejected_targets: int = 0) -> DataFrame:
    """(problem, found, required) rows for a table that cannot be split; none if it can.

    `classes` are the class counts of the rows that have a target.
    """
    facts = classes.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.coalesce(F.min("rows"), F.lit(0)).alias("smallest"),
    ).withColumn("n_test", F.ceil(F.col("n") * F.lit(config.test_size)).cast("bigint"))
    n, k, n_test = F.col("n"), F.col("k"), F.col("n_test")
    checks = [("too_few_rows", n < 5, n, F.lit(5))]
    if task == M.CLASSIFICATION:
        checks.append(("too_few_classes", k < 2, k, F.lit(2)))
        if config.stratify_classification:
            smallest = F.col("smallest")
            checks += [
                ("class_too_small", smallest < 2, smallest, F.lit(2)),
                ("test_smaller_than_classes", n_test < k, n_test, k),
                ("train_smaller_than_classes", (n - n_test) < k, n - n_test, k),
            ]
    else:
        bad = F.lit(rejected_targets)
        checks.append(("target_not_numeric", bad > 0, bad, F.lit(0)))
    found = F.array(*[
        F.when(broken, F.struct(F.lit(name).alias("problem"), value.cast("bigint").alias("found"),
                                need.cast("bigint").alias("required")))
        for name, broken, value, need in checks
    ])
    return facts.select(F.inline(F.filter(found, lambda v: v.isNotNull())))


def split_quotas(classes: DataFrame, n: int, n_test: int) -> DataFrame:
    """(class, rows, quota): proportional shares of the test rows by largest remainder.

    A tie goes to the larger class, then to the lower label. Products of row counts exceed 64
    bits on large tables, hence decimals. One row per class.
    """
    product = F.col("rows").cast("decimal(18,0)") * F.lit(n_test).cast("decimal(18,0)")
    whole = F.lit(n).cast("decimal(18,0)")
    remainder = (product % whole).cast("decimal(18,0)")
    floor = ((product - remainder) / whole).cast("bigint")
    order = Window.orderBy(F.desc("_rest"), F.desc("rows"), F.asc(CLASS))
    return (
        classes.withColumn("_rest", remainder).withColumn("_floor", floor)
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_left", F.lit(n_test) - F.sum("_floor").over(Window.partitionBy()))
        .select(CLASS, "rows",
                (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("bigint"))
                .alias("quota"))
    )


# ---- the cut --------------------------------------------------------------------------------

def find_cut(rows: DataFrame, needs: DataFrame, n: int, ranked_rows: int = RANKED_ROWS,
             single: bool = False) -> DataFrame:
    """(class, prefix, need, size): the last test token of each class.

    `rows` holds (class, token) and `needs` (class, need) with need >= 1. `need` of the `size`
    rows with that very token belong to the test part; with unique keys both are one. Every
    narrowing step reads the two columns once and shuffles at most 4,096 counts per class.
    `single` says that there is but one class.
    """
    widths = [0]
    while n > ranked_rows * 16 ** widths[-1]:
        widths.append(widths[-1] + PREFIX_STEP)
    edge = needs.select(CLASS, F.lit("").alias("prefix"), "need")
    for known, width in zip(widths, [*widths[1:], TOKEN_WIDTH]):
        edge = materialize(_narrow(_inside(rows, edge, known, single), width), "cut")
    return edge


def _inside(rows: DataFrame, edge: DataFrame, known: int, single: bool) -> DataFrame:
    """Rows whose token starts with their class's prefix of `known` characters, and the need.

    With one class its prefix is a literal of the filter; otherwise the prefixes are looked up.
    """
    if single:
        only = edge.head()
        if only is None:
            return rows.where(F.lit(False)).withColumn("need", F.lit(0).cast("bigint"))
        inside = rows.where(F.col(TOKEN).startswith(only["prefix"])) if known else rows
        return inside.withColumn("need", F.lit(only["need"]).cast("bigint"))
    joined = rows.join(edge, CLASS)
    return joined.where(F.col(TOKEN).startswith(F.col("prefix"))) if known else joined


def _narrow(inside: DataFrame, width: int) -> DataFrame:
    """The prefix of `width` characters that holds the needed rank, and the rank inside it."""
    counts = (
        inside.groupBy(CLASS, "need", F.substring(TOKEN, 1, width).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("size"))
    )
    running = F.sum("size").over(Window.partitionBy(CLASS).orderBy("prefix"))
    before = F.col("_upto") - F.col("size")
    return (
        counts.withColumn("_upto", running)
        .where((F.col("_upto") >= F.col("need")) & (before < F.col("need")))
        .select(CLASS, "prefix", (F.col("need") - before).alias("need"), "size")
    )


@dataclass
class Split:
    """Rows with a `split` column, plus what was decided about them."""

    rows: DataFrame
    n: int
    n_test: int
    stratified: bool
    quotas: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col(SPLIT) == name).drop(SPLIT)


def split_rows(df: DataFrame, test_size: float, seed: int, key: Sequence[str] | None = None,
               stratify_by: str | None = None, ranked_rows: int = RANKED_ROWS,
               classes: DataFrame | None = None) -> Split:
    """Split `df` exactly: ceil(n * test_size) test rows, in proportion per class if stratified.

    `key` names columns that identify a row; without it the whole row does. `classes` are the
    class counts where the caller has them stored already.
    """
    names = list(key or df.columns)
    token = keyed_token([quoted(c) for c in names], seed)
    hashed = df.withColumn(CLASS, _class_of(stratify_by)).withColumn(TOKEN, token)
    if classes is None:
        classes = materialize(class_counts(df, stratify_by), "classes")
    n = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
    n_test = test_rows(n, test_size)
    quotas = materialize(split_quotas(classes, n, n_test), "quotas")
    needs = quotas.where("quota > 0").select(CLASS, F.col("quota").alias("need"))
    marked = mark_rows(hashed, needs, n, df.columns, ranked_rows, stratify_by is None)
    return Split(marked, n, n_test, stratify_by is not None, quotas)


def mark_rows(hashed: DataFrame, needs: DataFrame, n: int, names: Sequence[str],
              ranked_rows: int = RANKED_ROWS, single: bool = False) -> DataFrame:
    """The columns `names` and the split of rows with class and token: `need` test rows a class."""
    cut = find_cut(hashed.select(CLASS, TOKEN), needs, n, ranked_rows, single)
    if cut.where("need < size").head() is not None:
        return _split_ties(hashed, cut, n, ranked_rows, names, single)
    # A stored table of one row per class: the optimizer knows its size and broadcasts it.
    return _decide(_look_up(hashed, cut, {"_last": F.col("prefix")}, single), TOKEN, names)


def _class_of(target: str | None) -> Column:
    return F.lit("all") if target is None else quoted(target)


def _decide(rows: DataFrame, token: str, names: Sequence[str]) -> DataFrame:
    """The split column; a class without test rows has no cut, so all of it is train."""
    is_test = F.coalesce(F.col(token) <= F.col("_last"), F.lit(False))
    return rows.select(*[quoted(c) for c in names],
                       F.when(is_test, TEST).otherwise(TRAIN).alias(SPLIT))


def _split_ties(hashed: DataFrame, cut: DataFrame, n: int, ranked_rows: int,
                names: Sequence[str], single: bool) -> DataFrame:
    """The split where the cut runs through rows with one token.

    Such rows are cut again by a token over all of their columns. What still ties is copies of
    one row: those are counted, divided by number, and written out again over many tasks.
    """
    full = hashed.withColumn("_full", whole_row_token(hashed.schema, names))
    columns = {"_last": F.col("prefix"), "need": F.col("need"), "size": F.col("size")}
    joined = _look_up(full, cut, columns, single)
    tied = (F.col(TOKEN) == F.col("_last")) & (F.col("need") < F.col("size"))
    is_tied = F.coalesce(tied, F.lit(False))
    ties = joined.where(is_tied).select(*[quoted(c) for c in names], CLASS,
                                        F.col("_full").alias(TOKEN))
    second = find_cut(ties.select(CLASS, TOKEN),
                      cut.where("need < size").select(CLASS, "need"), n, ranked_rows, single)
    clear = _decide(joined.where(~is_tied), TOKEN, names)
    copied = F.when(F.col("need") < F.col("size"), F.col("prefix"))
    marked = _look_up(ties, second, {**columns, "_copied": copied}, single)
    is_copy = F.coalesce(F.col(TOKEN) == F.col("_copied"), F.lit(False))
    settled = _decide(marked.where(~is_copy), TOKEN, names)
    # Counted per full row: should two rows ever share a token, the wanted test rows go to one
    # after the other, and every row is written out as often as it came in.
    counted = marked.where(is_copy).groupBy(
        CLASS, TOKEN, *[quoted(c) for c in names]).agg(
        F.max("need").alias("need"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(CLASS, TOKEN).orderBy(
        *[quoted(c) for c in names]).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.greatest(F.lit(0), F.least(
        F.col("_rows"), F.col("need") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
    both = counted.withColumn("_test", wanted).select(
        *[quoted(c) for c in names], F.inline(F.array(
            F.struct(F.lit(TEST).alias(SPLIT), F.col("_test").alias("_times")),
            F.struct(F.lit(TRAIN).alias(SPLIT), (F.col("_rows") - F.col("_test")).alias("_times")),
        )))
    return clear.unionByName(settled).unionByName(_repeat(both))


def _look_up(rows: DataFrame, cut: DataFrame, columns: dict[str, Column],
             single: bool) -> DataFrame:
    """Rows with values of their class's cut: literals for one class, else a left join."""
    wanted = cut.select(CLASS, *[c.alias(name) for name, c in columns.items()])
    if not single:
        return rows.join(wanted, CLASS, "left")
    only = wanted.head()
    return rows.withColumns({
        name: F.lit(only[name] if only else None).cast(wanted.schema[name].dataType)
        for name in columns
    })


def _repeat(df: DataFrame) -> DataFrame:
    """Every row `_times` times, at most a million of them from one task."""
    blocks = F.ceil(F.col("_times") / COPIES_PER_TASK).cast("bigint")
    spread = (
        df.where("_times > 0").withColumn("_block", F.explode(F.sequence(F.lit(1), blocks)))
        .repartition("_block", *[quoted(c) for c in df.columns if c != "_times"])
    )
    left = F.col("_times") - (F.col("_block") - 1) * COPIES_PER_TASK
    size = F.least(F.lit(COPIES_PER_TASK), left).cast("bigint")
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), size))).drop(
        "_times", "_block", "_copy")


def split_counts(rows: DataFrame, missing: DataFrame, stratified: bool) -> DataFrame:
    """One row: train_rows, test_rows, target_missing_rows, stratified."""
    def count(name: str) -> Column:
        return F.coalesce(F.sum((F.col("part") == name).cast("bigint")), F.lit(0))

    parts = rows.select(F.col(SPLIT).alias("part")).unionAll(
        missing.select(F.lit("target_missing").alias("part")))
    return parts.agg(
        count(TRAIN).alias("train_rows"), count(TEST).alias("test_rows"),
        count("target_missing").alias("target_missing_rows"),
        F.lit(stratified).alias("stratified"),
    )
