"""Line dedup: a suffix array over line ids finds repeated runs of lines; later copies go.

Documents are sequences of line ids. Lines that occur once cannot be in a repeated run, so only
positions of repeated lines enter the suffix array. It is built by prefix doubling: rank k orders
the positions by their first 2^k lines, and rank k+1 is the order of pairs (rank k here, rank k
2^k lines on). Ranks are given to distinct pairs by one global sort, whose row numbers increase
with the order; pairs that occur once get none, since no longer run begins there.

A run counts when it has `min_words` words. Every position begins a window, the fewest lines from
there on that reach them, and ends one, the fewest lines up to there. For a window of m lines from
s on, the suffixes that share these lines are neighbours in the suffix array, an interval of common
prefixes of length m or more; two overlapping ranks name it: rank k at s and at s + m - 2^k, with
2^k <= m < 2^(k+1). All positions of an interval but its first, and those that overlap it, lose
these m lines.
A line of a longer repeated run lies in the window it begins if the run has the words from there on,
in the one it ends if the run has them up to there, and else in the window that the run's first line
begins. All three lie inside the run, so no more than log2(min_words) rounds are needed, and maximal
runs are removed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import (
    WORD,
    apart,
    doc_columns,
    full_text,
    let,
    named,
    unused_name,
    words,
)
from furrow.session import materialize

MIN_WORDS = 50
DOC = ["doc_id", "text_mark"]


def _ranked(pairs: DataFrame, by: list[str], rank: str, label: str) -> DataFrame:
    """The distinct pairs that occur more than once, with a rank in their order."""
    repeated = pairs.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return materialize(
        repeated.orderBy(*by).select(*by, F.monotonically_increasing_id().alias(rank)), label)


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: document, number among these, place, 128-bit id, words."""
    numbered = F.transform(F.split("text", "\n"), lambda line, at: F.struct(
        at.alias("at"), line.alias("line")))
    with_word = F.filter(numbered, lambda x: x["line"].rlike(WORD))
    return docs.select("doc_id", F.xxhash64("text").alias("text_mark"),
                       F.posexplode(with_word).alias("seq", "x")).select(
        *DOC, "seq", "x.at", F.unhex(F.md5(F.col("x.line").cast("binary"))).alias("line"),
        F.size(words(F.col("x.line"))).alias("n_words"))


def _fewest_lines(positions: Column, start: Column, min_words: int, step: int = 1) -> Column:
    """Lines from the start on that reach `min_words`, without a gap; null if they never do.

    With a step of -1, lines from the start backwards.
    """
    first = F.get(positions, start)
    listed = F.slice(positions, start + 1, min_words) if step > 0 else F.reverse(F.slice(
        positions, F.greatest(start + 2 - min_words, F.lit(1)), F.least(start + 1, F.lit(min_words))))
    reached = F.aggregate(
        listed, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")),
        lambda done, x: F.when(
            (done["w"] < min_words) & (x["seq"] == first["seq"] + step * done["n"]),
            F.struct((done["n"] + 1).alias("n"), (done["w"] + x["n_words"]).alias("w"))
        ).otherwise(done))
    return let(reached, lambda r: F.when(r["w"] >= min_words, r["n"]))


def _doubled(rows: DataFrame, level: int) -> DataFrame:
    """`rows` with rank `level`, from pairs of rank `level - 1`."""
    step, before = 1 << (level - 1), f"r{level - 1}"
    ahead = Window.partitionBy(*DOC).orderBy("seq")
    paired = rows.withColumn("ahead", F.when(
        F.lead("seq", step).over(ahead) == F.col("seq") + step, F.lead(before, step).over(ahead)))
    paired = materialize(paired, f"lines-pairs-{level}")
    both = paired.where(F.col(before).isNotNull() & F.col("ahead").isNotNull())
    ranks = _ranked(both.select(before, "ahead"), [before, "ahead"], f"r{level}",
                    f"lines-ranks-{level}")
    return paired.join(ranks, [before, "ahead"], "left").drop("ahead")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_mark, places): the lines, counted from zero, that each document loses."""
    lines = materialize(_lines(doc_columns(docs, id_col, text_col)), "lines")
    ranks = _ranked(lines.select("line"), ["line"], "r0", "lines-ranks-0")
    repeated = lines.join(ranks, "line").groupBy(*DOC).agg(F.sort_array(F.collect_set(
        F.struct("seq", "at", "n_words", "r0"))).alias("positions"))

    def with_needs(positions: Column) -> Column:
        return F.transform(positions, lambda x, k: F.struct(
            x["seq"].alias("seq"), x["at"].alias("at"), x["r0"].alias("r0"),
            _fewest_lines(positions, k, min_words).alias("need"),
            _fewest_lines(positions, k, min_words, -1).alias("need_back")))

    needs = repeated.select(*DOC, let(F.col("positions"), with_needs).alias("positions")).where(
        F.exists("positions", lambda x: x["need"].isNotNull()))
    rows = materialize(needs.select(*DOC, F.inline("positions")), "lines-positions")
    longest = rows.agg(F.max(F.greatest("need", "need_back"))).first()[0]
    if longest is None:
        return rows.select(*DOC, F.array("at").alias("places"))
    levels = longest.bit_length() - 1
    for level in range(1, levels + 1):
        rows = _doubled(rows, level)

    # Overlapping ranks at the start and at the end name the interval of each window.
    whole = rows.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct(
        "seq", "at", "need", "need_back", F.array(*[f"r{k}" for k in range(levels + 1)]).alias("r")))).alias(
        "positions"))

    def windows(positions: Column) -> Column:
        def window(start: Column, need: Column) -> Column:
            level = F.floor(F.log2(need + F.lit(0.5))).cast("int")
            return let(level, lambda n: F.struct(
                F.get(positions, start)["seq"].alias("seq"), need.alias("need"),
                F.get(F.get(positions, start)["r"], n).alias("front"),
                F.get(F.get(positions, start + need - F.pow(F.lit(2), n).cast("int"))["r"],
                      n).alias("back"),
                F.transform(F.slice(positions, start + 1, F.greatest(need, F.lit(1))),
                            lambda y: y["at"]).alias("places")))

        def ended(x: Column, k: Column) -> Column:
            # A window that its first line also begins is there already.
            start = k + 1 - x["need_back"]
            return F.when(x["need_back"] != F.get(positions, start)["need"],
                          window(start, x["need_back"]))

        begun = F.transform(positions, lambda x, k: F.when(
            x["need"].isNotNull(), window(k, x["need"])))
        return F.filter(F.concat(begun, F.transform(positions, ended)), lambda x: x[
            "front"].isNotNull() & x["back"].isNotNull())

    found = materialize(whole.select(*DOC, F.inline(let(F.col("positions"), windows))),
                        "lines-windows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_mark", "seq")
    interval = ["need", "front", "back"]
    first = found.groupBy(*interval).agg(F.min(order).alias("first"), F.count("*").alias("n")
                                         ).where("n > 1").drop("n")
    same = F.struct(F.col("doc_id").isNull(), "doc_id", "text_mark").eqNullSafe(F.struct(
        F.col("first.none"), F.col("first.doc_id"), F.col("first.text_mark")))
    later = found.join(first, interval).where(
        ~same | (F.col("seq") >= F.col("first.seq") + F.col("need")))
    return materialize(later.groupBy(*DOC).agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), "lines-removed")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           min_words: int = MIN_WORDS, removed: str = "n_removed",
                           total: str = "n_lines") -> DataFrame:
    """`docs`, the text without later copies of repeated runs, and counts of lines.

    A run is a sequence of whole lines, lines without a word left aside, with `min_words` words or
    more. Of equal runs the one in the smallest (doc_id, place) stays; null ids come last. Lines
    are equal when their 128-bit digests are. Null texts stay null; rows that repeat id and text
    are one document and are treated alike; an empty table gives an empty result. Other columns
    are kept, whatever their names; the counts take the names given.
    """
    gone = removed_lines(docs, id_col, text_col, min_words)
    key, mark, cut = (unused_name(docs, n) for n in ("gone_id", "gone_mark", "gone_places"))
    touched, untouched = apart(
        docs, F.xxhash64(named(id_col), F.xxhash64(full_text(text_col))),
        gone, F.xxhash64("doc_id", "text_mark"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("text_mark").alias(mark),
                       F.col("places").alias(cut))
    rows = touched.join(gone.hint("merge"), named(id_col).eqNullSafe(F.col(key)) & (
        F.xxhash64(full_text(text_col)) == F.col(mark)), "left")
    lines = F.split(full_text(text_col), "\n")

    def kept(all_lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(cut))
        return F.array_join(F.transform(numbers, lambda k: F.get(all_lines, k)), "\n")

    text = F.when(F.col(cut).isNull(), named(text_col)).otherwise(let(lines, kept))
    counted = F.size(lines).cast("long").alias(total)
    return rows.select(
        *[text.alias(c) if c == text_col else named(c) for c in docs.columns],
        counted, F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(removed)).unionAll(
        untouched.select("*", counted, F.lit(0).cast("long").alias(removed)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, text without repeated runs, n_lines, n_removed."""
    slim = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return without_repeated_lines(slim, min_words=min_words)
