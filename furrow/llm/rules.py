"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD, doc_columns, full_text, let, words

# ---- fixed values: frequent function words of English, French, German and Spanish -----------
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "for", "that", "with", "as", "on", "be",
    "at", "by", "this", "was", "are", "or", "from", "not",
    "le", "la", "de", "et", "les", "des", "un", "une", "en", "que", "est", "dans", "du", "qui",
    "au", "par", "pour", "pas", "sur", "avec",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "dem", "ein", "eine",
    "ist", "im", "nicht", "als",
    "el", "los", "las", "y", "se", "por", "del", "con", "no", "para", "al", "es", "lo", "su",
)
NO_MARK = r"[^#*$%&|<>!]+"
WINDOW = 5
FEWEST_WORDS = 10
REPEAT_PERCENT = 20
# -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A text passes if its metric lies between both bounds; texts of fewer words are exempt."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0

    def fails(self, metric: Column, n_words: Column) -> Column:
        outside = F.lit(False)
        if self.least is not None:
            outside = outside | (metric < self.least)
        if self.most is not None:
            outside = outside | (metric > self.most)
        return outside & (n_words >= self.from_words)


RULES = (
    Rule("word_length", "chars_per_word", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("exclamations", "exclamations_per_word", most=0.5),
    Rule("stop_words", "stop_words_found", least=2, from_words=30),
    Rule("repeated_lines", "dup_line_ratio", most=0.3),
    Rule("short_lines", "lines_per_word", most=0.5),
)


def metrics(counts: Column) -> dict[str, Column]:
    """The ratios that rules can name, over one row's counts."""
    def per(part: Column, whole: Column) -> Column:
        return part / F.greatest(whole, F.lit(1))

    w, lines, marks = counts["w"], counts["l"], counts["m"]
    return {
        "chars_per_word": per(w["word_chars"], w["n_words"]),
        "symbols_per_word": per(marks["n_symbols"], w["n_words"]),
        "exclamations_per_word": per(marks["n_exclamations"], w["n_words"]),
        "stop_words_found": w["n_stop_words"],
        "dup_line_ratio": per(lines["n_dup_lines"], lines["n_lines"]),
        "lines_per_word": per(lines["n_lines"], w["n_words"]),
    }


def _is(found: Column) -> Column:
    return F.coalesce(found, F.lit(False))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these places, in any order."""
    def steps(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda total, step: total + step)

    return let(F.sort_array(starts), steps)


def _beside_equal(windows: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Places of the windows that equal a neighbour in this order."""
    return F.transform(F.filter(windows, lambda x, k: _is(
        same(x, F.get(windows, k - 1))) | _is(same(x, F.get(windows, k + 1)))),
        lambda x: x["i"])


def _covered_words(word_list: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more: equal windows sort side by side.

    Windows are ordered by their hash, and neighbours with one hash are compared word by word.
    Should two of them differ, the text is done again in the order of the windows themselves.
    """
    def same_words(x: Column, y: Column) -> Column:
        equal = F.get(word_list, x["i"]) == F.get(word_list, y["i"])
        for k in range(1, WINDOW):
            equal = equal & (F.get(word_list, x["i"] + k) == F.get(word_list, y["i"] + k))
        return equal

    def by_hash(windows: Column) -> Column:
        collide = F.exists(F.sequence(F.lit(1), F.size(windows) - 1), lambda k: (
            F.get(windows, k)["h"] == F.get(windows, k - 1)["h"]) & ~same_words(
            F.get(windows, k), F.get(windows, k - 1)))
        whole = F.sort_array(F.transform(windows, lambda x: F.struct(
            F.array_join(F.slice(word_list, x["i"] + 1, WINDOW), " ").alias("w"),
            x["i"].alias("i"))))
        starts = F.when(collide, let(whole, lambda ordered: _beside_equal(
            ordered, lambda x, y: x["w"] == y["w"]))).otherwise(
            _beside_equal(windows, lambda x, y: x["h"] == y["h"]))
        return _covered(starts)

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(
        h.alias("h"), i.alias("i")))), by_hash)


def repeated_words(word_list: Column) -> Column:
    """Words in 5-word windows that the text holds twice or more, first ones included.

    Equal windows have equal hashes, so a text without a repeated hash is done; only the others
    compare the windows themselves.
    """
    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(
            hashes, lambda h: F.when(
                F.size(F.array_distinct(h)) == F.size(h), F.lit(0)
            ).otherwise(_covered_words(w, h))))

    return let(word_list, count)


def _counts(text: Column) -> Column:
    """The counts that the rules use, as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def by_word(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias(
                "n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"))

    def by_line(kept: Column) -> Column:
        return F.struct(
            F.size(kept).cast("long").alias("n_lines"),
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"))

    def by_mark(marks: Column) -> Column:
        calm = F.length(F.replace(marks, F.lit("!"), F.lit("")))
        return F.struct(calm.cast("long").alias("n_symbols"),
                        (F.length(marks) - calm).cast("long").alias("n_exclamations"))

    return F.struct(
        let(words(text), by_word).alias("w"), let(lines, by_line).alias("l"),
        let(F.regexp_replace(text, NO_MARK, ""), by_mark).alias("m"))


def _verdict(counts: Column, rules: Sequence[Rule]) -> Column:
    """The threshold table over the counts of one row, as one struct."""
    def of(c: Column) -> Column:
        n_words, known = c["w"]["n_words"], metrics(c)
        failed = [F.when(rule.fails(known[rule.metric], n_words), F.lit(rule.name))
                  for rule in rules]
        names = F.filter(F.array(*failed, F.lit(None).cast("string")),
                         lambda name: name.isNotNull())
        base = (n_words < FEWEST_WORDS) | (
            100 * c["w"]["n_repeat_words"] > REPEAT_PERCENT * n_words)
        return let(names, lambda found: F.struct(
            c.alias("c"), base.alias("base_failed"), found.alias("failed_rules"),
            (~base & (F.size(found) == 0)).alias("kept")))

    return let(counts, of)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of `docs`: counts, base_failed, the names of failed rules, kept.

    A null or empty text has no word and fails the base rule. Repeated rows are judged each for
    itself, other columns are not read, and an empty table gives an empty result. The longest
    texts are judged whole. Nothing is shuffled.
    """
    judged = doc_columns(docs, id_col, text_col).select(
        "doc_id", _verdict(_counts(F.col("text")), rules).alias("v"))
    return judged.select(
        "doc_id", "v.c.w.n_words", "v.c.w.word_chars", "v.c.m.n_symbols", "v.c.l.n_dup_lines",
        "v.c.w.n_repeat_words", "v.base_failed", "v.kept", "v.c.l.n_lines",
        "v.c.m.n_exclamations", "v.c.w.n_stop_words", "v.failed_rules")


def passing(docs: DataFrame, text_col: str = "text",
            rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs` whose text passes, with all their columns."""
    return docs.where(_verdict(_counts(full_text(text_col)), rules)["kept"])
