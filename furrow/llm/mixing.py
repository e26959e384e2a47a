"""Mixing sources to target weights: weighted sampling by exponential keys up to token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import full_text, named, unused_name, word_count
from furrow.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
KEY_BITS = 52


def quality_weight(text: Column) -> Column:
    """How much a document is favoured: less, the more of its characters are symbols."""
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return 1 / (1 + 20 * symbols / F.greatest(F.length(text), F.lit(1)))


def _mark(doc_id: Column, text: Column, seed: str) -> Column:
    """Hex digits that order documents alike in every run; equal rows share them."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")),
                             F.md5(text.cast("binary"))).cast("binary"))


def exponential_key(mark: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the mark: the smallest keys are a weighted sample."""
    u = (F.conv(F.substring(mark, 1, KEY_BITS // 4), 16, 10).cast("double") + 0.5) / (
        1 << KEY_BITS)
    return -F.log(u) / weight


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str],
                 label: str) -> DataFrame:
    """`df` with sums over all rows before each row in a global order.

    Rows are dealt by ranges of the order, so a group that holds many of them is spread; inside a
    range a window adds up, and the ranges' totals, one row each, are added up before.
    """
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)
    totals = ranged.groupBy("part").agg(*[F.sum(c).alias(f"{c}_in") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[
        F.coalesce(F.sum(f"{c}_in").over(earlier), F.lit(0)).alias(f"{c}_off") for c in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    return ranged.select("*", *[
        F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_before") for c in sums]).join(
        offsets, "part").select(
        *df.columns, *[(F.col(f"{c}_off") + F.col(f"{c}_before")).alias(name)
                       for c, name in sums.items()])


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for a table (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` of all
    sizes by weight. No target exceeds `most_epochs` times its source; the excess is shared anew
    until none does. With r the ratio of that limit to the weight, the limited sources are those
    of smallest r, so one pass in the order of r finds the level that all others share.
    """
    ordered = running_sums(
        sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()],
        {"one": "rank"}, "mix-sources")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.col("rank") % len(weights) + 1).cast("int"))
    limited = ordered.select(
        "source", "source_size", turn.alias("weight"),
        (F.col("source_size") * float(most_epochs)).alias("most"))
    rows = limited.withColumn("ratio", F.col("most") / F.col("weight"))
    filled = running_sums(rows, [F.col("ratio"), F.col("source").asc_nulls_last()],
                          {"most": "most_before", "weight": "weight_before"}, "mix-levels")
    total, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * float(total or 0)
    level = (F.lit(wanted) - F.col("most_before")) / (
        F.lit(float(weight or 0)) - F.col("weight_before"))
    found = filled.select("ratio", level.alias("level")).where("level <= ratio").agg(
        F.min_by("level", "ratio")).first()[0]
    everyone = F.col("weight") * F.lit(float("inf") if found is None else found)
    return filled.select("source", "source_size",
                         F.least("most", everyone).alias("target"))


def _sampled(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality,
             seed: str) -> list[Column]:
    text = full_text(text_col)
    mark = _mark(named(id_col), text, seed)
    return [named(id_col).alias("doc_id"), named(source_col).cast("string").alias("source"),
            word_count(text).alias("size"), mark.alias("mark"),
            exponential_key(mark, quality(text)).alias("key")]


def _cuts(slim: DataFrame, weights, share, most_epochs) -> DataFrame:
    """Per source: source_size, target, whole epochs, and the last (key, mark) of the rest."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, most_epochs), "mix-targets")
    # Equal rows are spread by their number; which of them comes first makes no difference.
    summed = running_sums(
        slim.withColumn("row", F.monotonically_increasing_id()),
        [F.col("source").asc_nulls_last(), F.col("key"), F.col("mark"), F.col("row")],
        {"size": "before"}, "mix-order")
    base = materialize(summed.select("source", "size", "key", "mark", "before"), "mix-sums")
    starts = base.groupBy("source").agg(F.min("before").alias("start"))
    budgets = targets.join(starts, targets["source"].eqNullSafe(starts["source"])).select(
        targets["source"], "source_size", "target", "start",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("int").alias("epochs"))
    budgets = materialize(budgets, "mix-budgets")
    b = budgets.select(F.col("source").alias("of"), "start",
                       (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    # A document is in if the sum up to its middle is within the budget.
    inside = base.join(b, base["source"].eqNullSafe(b["of"])).where(
        (F.col("before") - F.col("start") + F.col("size") / 2 <= F.col("rest"))
        & (F.col("size") > 0) & (F.col("rest") > 0))
    last = inside.groupBy(F.col("of")).agg(
        F.max(F.struct("key", "mark")).alias("last"))
    return materialize(
        budgets.join(last, budgets["source"].eqNullSafe(last["of"]), "left").select(
            F.col("source").alias("of"), "source_size", "target", "epochs", "last"), "mix-cuts")


def _times() -> Column:
    """How often a document is taken: whole epochs, and once more up to the cut."""
    again = F.coalesce(F.struct("key", "mark") <= F.col("last"), F.lit(False))
    return F.when(F.col("size") > 0, F.col("epochs") + again.cast("int")).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most_epochs: float = MOST_EPOCHS, quality=quality_weight,
        seed: str = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken.

    Size is the number of words (null text: none). Every source first gives its whole epochs, then
    documents in the order of their exponential keys, scaled by quality, until the sum comes
    nearest its target. A null source is a source; rows that repeat id and text are taken alike;
    documents without a word, and sources of only such, are taken zero times; an empty table gives
    an empty result. Ids decide the sample, so reruns agree for any partitioning.
    """
    slim = materialize(docs.select(*_sampled(docs, id_col, text_col, source_col, quality, seed)),
                       "mix-docs")
    cuts = _cuts(slim, weights, share, most_epochs)
    return slim.join(cuts, slim["source"].eqNullSafe(cuts["of"])).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * _times()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", weights: Sequence[float] = WEIGHTS,
                    share: float = SHARE, most_epochs: float = MOST_EPOCHS,
                    quality=quality_weight, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns.

    What stays and how often is a comparison with the cut of the row's source, a table with one
    row per source; no text is shuffled while that table is small enough to be broadcast.
    """
    slim = docs.select(*_sampled(docs, id_col, text_col, source_col, quality, seed))
    cuts = _cuts(materialize(slim, "mix-docs"), weights, share, most_epochs)
    drawn, times = unused_name(docs, "drawn"), unused_name(docs, "times")
    parts = _sampled(docs, id_col, text_col, source_col, quality, seed)
    rows = docs.withColumn(drawn, F.struct(*parts))
    copies = rows.join(cuts.select(F.struct("*").alias("cut")), F.col(f"{drawn}.source").eqNullSafe(
        F.col("cut.of")))
    again = F.coalesce(F.struct(f"{drawn}.key", f"{drawn}.mark") <= F.col("cut.last"),
                       F.lit(False))
    number = F.when(F.col(f"{drawn}.size") > 0, F.col("cut.epochs") + again.cast("int"))
    return copies.where(number > 0).select(
        *[named(c) for c in docs.columns],
        F.explode(F.sequence(F.lit(1), number)).alias(times)).drop(times)
