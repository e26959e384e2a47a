"""New columns out of present ones: numbers in written form, parts of dates, scales, bins, arithmetic.

Everything here is a projection; what scales and bins need is learned from training rows before.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import NUMBER, bound, finite_double, normalize_category, quoted
from furrow.operators.outliers import exact_quantiles

# ---- fixed values: currency signs, and the days that spreadsheets count from -----------------
CURRENCY = r"[$€£¥₹]|\b(?:USD|EUR|GBP|CNY|JPY|INR)\b"
GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?$"
DAY_ZERO, FIRST_DAY, LAST_DAY = "1899-12-30", 61, 2_958_465
# -----------------------------------------------------------------------------------------------
DATE_PARTS = ("year", "quarter", "month", "day", "weekday", "hour", "is_weekend")


# ---- numbers in written form ----------------------------------------------------------------------

def parse_number(value: Column) -> Column:
    """The number that a text stands for, null if none.

    Plain and scientific notation, thousands in groups of three, one currency sign or code at either
    end, a percent sign (divided by 100), and parentheses for a negative amount. A comma that does not
    part groups of three is no decimal point: such text is no number.
    """
    return bound(normalize_category(value), _unsigned)


def _unsigned(text: Column) -> Column:
    def signed(inner: Column) -> Column:
        number = bound(F.trim(F.regexp_replace(inner, r"\s*%\s*$", "")), _amount)
        return F.when(inner.rlike(r"%\s*$"), number / 100).otherwise(number)

    # A sign inside parentheses would be a second one.
    second = text.rlike(rf"^\(\s*(?:{CURRENCY})?\s*[+-]")
    inner = F.when(text.rlike(r"^\(.*\)$"), F.regexp_replace(text, r"^\((.*)\)$", "$1"))
    return F.when(inner.isNull(), bound(text, signed)).when(~second, -bound(inner, signed))


def _amount(bare: Column) -> Column:
    plain = F.trim(F.regexp_replace(bare, rf"^([+-]?)\s*(?:{CURRENCY})\s*|\s*(?:{CURRENCY})$", "$1"))

    def number(text: Column) -> Column:
        digits = F.when(text.rlike(GROUPED), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
        return bound(digits, lambda d: F.when(d.rlike(NUMBER), d.try_cast("double")))

    return bound(plain, number)


def parse_serial_date(value: Column) -> Column:
    """The date of a spreadsheet's day number; null outside 1900-03-01 to 9999-12-31.

    Earlier numbers are ambiguous, since spreadsheets count a day that 1900 did not have.
    """
    return bound(parse_number(value), lambda n: F.when(
        n.between(FIRST_DAY, LAST_DAY + 0.999999),
        F.date_add(F.lit(DAY_ZERO).cast("date"), F.floor(n).cast("int"))))


def parse_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, present, parsed, rejected): how many texts stand for numbers. One pass."""
    counts = df.agg(*[F.struct(
        F.count(quoted(c)).alias("present"), F.count(parse_number(quoted(c))).alias("parsed")).alias(
        f"_{i}") for i, c in enumerate(columns)])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"_{i}.present").alias("present"),
        F.col(f"_{i}.parsed").alias("parsed"),
        (F.col(f"_{i}.present") - F.col(f"_{i}.parsed")).alias("rejected"))
        for i, c in enumerate(columns)])))


# ---- dates and arithmetic ------------------------------------------------------------------------

def date_features(df: DataFrame, columns: Sequence[str],
                  parts: Sequence[str] = DATE_PARTS) -> DataFrame:
    """`df` with every named date or time replaced by whole numbers `<name>__<part>`.

    Weeks begin on Monday (1). Text that is no time, like null, gives null parts. A run takes these
    columns as numbers, where it refuses the time itself.
    """
    unknown = [p for p in parts if p not in DATE_PARTS]
    if unknown:
        raise M.PreparationError("no such part of a date: " + ", ".join(unknown))
    names = [f"{c}__{p}" for c in columns for p in parts]
    taken = [n for n in names if n.lower() in (c.lower() for c in df.columns)]
    if taken:
        raise M.PreparationError("such columns exist already: " + ", ".join(taken))

    def part(time: Column, name: str) -> Column:
        weekday = F.weekday(time) + 1
        return {"year": F.year(time), "quarter": F.quarter(time), "month": F.month(time),
                "day": F.dayofmonth(time), "weekday": weekday, "hour": F.hour(time),
                "is_weekend": (weekday >= 6).cast("int")}[name]

    return df.select(*[quoted(c) for c in df.columns if c not in columns], *[
        part(quoted(c).try_cast("timestamp"), p).alias(f"{c}__{p}") for c in columns for p in parts])


def combine(df: DataFrame, outputs: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """`df` with new columns from (left, operation, right): sum, difference, product or ratio.

    Null where a side is no finite number, a divisor is zero or the result is not finite.
    """
    types = {f.name: f.dataType for f in df.schema}
    added = []
    for name, (left, operation, right) in outputs.items():
        if name.lower() in (c.lower() for c in df.columns):
            raise M.PreparationError(f"such a column exists already: {name}")
        a, b = (finite_double(quoted(c), types[c]) for c in (left, right))
        if operation not in ("sum", "difference", "product", "ratio"):
            raise M.PreparationError(f"no such operation: {operation}")
        result = {"sum": a + b, "difference": a - b, "product": a * b,
                  "ratio": F.try_divide(a, b)}[operation]
        added.append(F.when(result - result == 0, result).alias(name))
    return df.select("*", *added)


# ---- scales and bins --------------------------------------------------------------------------------

@dataclass
class ScaleState:
    """Centre and scale per column, or the inner edges of its bins, from training rows."""

    robust: dict[str, list[float]]
    edges: dict[str, list[float]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ScaleState:
        return cls(**json.loads(text))


def fit_scales(train: DataFrame, robust: Sequence[str] = (), by_quantile: Mapping[str, int] | None = None,
               by_width: Mapping[str, int] | None = None) -> ScaleState:
    """Medians and quartile ranges (1 where that is 0), and edges of bins of equal share or width.

    Quantiles are exact, found for all columns in one descent. Equal edges are one, so a column of few
    values gets fewer bins. A column without values is refused.
    """
    by_quantile, by_width = dict(by_quantile or {}), dict(by_width or {})
    if set(by_quantile) & set(by_width):
        raise M.PreparationError("a column is binned in two ways")
    if any(n < 2 for n in (*by_quantile.values(), *by_width.values())):
        raise M.PreparationError("there are two bins at least")
    shares = sorted({0.0, 0.25, 0.5, 0.75, 1.0,
                     *(i / n for n in by_quantile.values() for i in range(1, n))})
    names = list(dict.fromkeys([*robust, *by_quantile, *by_width]))
    found = {c: dict(zip(shares, q)) for c, q in exact_quantiles(train, names, shares).items()}
    empty = [c for c in names if found[c][0.0] is None]
    if empty:
        raise M.PreparationError("no value in the training rows: " + ", ".join(empty))
    edges = {c: sorted({found[c][i / n] for i in range(1, n)}) for c, n in by_quantile.items()}
    for c, n in by_width.items():
        low, high = found[c][0.0], found[c][1.0]
        edges[c] = sorted({low + (high - low) * i / n for i in range(1, n)}) if low < high else []
    return ScaleState({c: [found[c][0.5], (found[c][0.75] - found[c][0.25]) or 1.0] for c in robust},
                      edges)


def scale_robust(df: DataFrame, state: ScaleState) -> DataFrame:
    """The columns less their median, divided by their quartile range; null stays null."""
    return _replaced(df, {c: lambda x, m=m, s=s: (x - F.lit(m)) / F.lit(s)
                          for c, (m, s) in state.robust.items()})


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Logarithms of 1 plus the size, with the sign of the value, so that all numbers have one."""
    return _replaced(df, dict.fromkeys(columns, lambda x: F.signum(x) * F.log1p(F.abs(x))))


def bin_numbers(df: DataFrame, state: ScaleState) -> DataFrame:
    """The columns as the number of their bin, from 0; a value on an edge is in the upper bin."""
    def place(x: Column, edges: list[float]) -> Column:
        inner = F.array(F.lit(None).cast("double"), *map(F.lit, edges))
        return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e <= x)))

    return _replaced(df, {c: lambda x, e=e: place(x, e) for c, e in state.edges.items()})


def _replaced(df: DataFrame, changes: Mapping) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        changes[c](finite_double(quoted(c), types[c])).alias(c) if c in changes else quoted(c)
        for c in df.columns])
