"""Outliers by the distance from the quartiles: learned from training rows, then kept, flagged,
clipped, emptied or dropped.

All quantiles of all columns are found in one descent. A pass counts, for every rank still open, the
values of the range that holds it in ordered buckets: by sign and binary exponent first, in equal
widths then. The range shrinks to the bucket of the rank until that holds a single value, so quantiles
are exact however many values tie. A pass shuffles at most a few thousand counts per rank and task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import finite_double, quoted
from furrow.session import materialize

BUCKETS = 512
# Columns whose ranks one pass looks for.
COLUMNS_PER_PASS = 24
# Distances from the quartiles, in quartile ranges, of outliers and of extreme ones.
MILD, EXTREME = 1.5, 3.0
KEEP, FLAG, CLIP, EMPTY, DROP = "keep", "flag", "clip", "null", "drop"
ACTIONS = (KEEP, FLAG, CLIP, EMPTY, DROP)
SUFFIX = "__outlier"


# ---- exact quantiles ----------------------------------------------------------------------------

@dataclass
class _Search:
    """The range of a column that holds some wanted ranks (from 0, counted in the whole column)."""

    column: int
    low: float
    high: float
    below: int
    ranks: list[int]
    by_exponent: bool = False

    def bucket(self, x: Column) -> Column:
        """Number of the bucket of x, never decreasing in x."""
        if self.by_exponent:
            exponent = F.coalesce(F.floor(F.log2(F.abs(x))), F.lit(-1100))
            return (F.signum(x) * (exponent + 1101)).cast("long")
        width = (self.high / BUCKETS - self.low / BUCKETS) or math.ulp(0.0)
        return F.least(F.floor((x - self.low) / F.lit(width)), F.lit(BUCKETS - 1)).cast("long")

    def narrowed(self, buckets: Sequence, found: dict[int, float]) -> list[_Search]:
        """The buckets that hold ranks, as new searches; ranks of one value go to `found`."""
        open_, below, ranks = [], self.below, sorted(self.ranks)
        for b in buckets:
            inside = [r for r in ranks if below <= r < below + b["n"]]
            if inside and b["low"] == b["high"]:
                found.update(dict.fromkeys(inside, b["low"]))
            elif inside:
                open_.append(_Search(self.column, b["low"], b["high"], below, inside))
            below += b["n"]
        return open_


def _count(numbers: DataFrame, searches: Sequence[_Search]) -> dict[int, list]:
    """Per search its buckets in order: bucket, n, low, high."""
    cells = []
    for k, s in enumerate(searches):
        x = F.col(f"x{s.column}")
        inside = x.isNotNull() if s.by_exponent else x.between(s.low, s.high)
        cells.append(F.when(inside, F.struct(
            F.lit(k).alias("k"), s.bucket(x).alias("bucket"), x.alias("x"))))
    rows = numbers.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    counted = rows.groupBy("k", "bucket").agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    found: dict[int, list] = {}
    # At most a few thousand counts per rank.
    for r in counted.collect():
        found.setdefault(r["k"], []).append(r)
    return {k: sorted(rows, key=lambda r: r["bucket"]) for k, rows in found.items()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]
                    ) -> dict[str, list[float | None]]:
    """The interpolated quantiles of the present finite values of each column; None without values.

    At share s of n values it is the value at place s * (n - 1), a straight line between the two next
    to it.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise M.PreparationError("shares lie between 0 and 1")
    types = {f.name: f.dataType for f in df.schema}
    result: dict[str, list[float | None]] = {}
    # Both zeros are one value.
    numbers = materialize(df.select(*[
        (finite_double(quoted(c), types[c]) + F.lit(0.0)).alias(f"x{i}")
        for i, c in enumerate(columns)]), "quantiles")
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = range(start, min(start + COLUMNS_PER_PASS, len(columns)))
        counts = numbers.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in chunk]).head()
        places = {i: [s * (counts[f"n{i}"] - 1) for s in shares] for i in chunk if counts[f"n{i}"]}
        values: dict[int, dict[int, float]] = {i: {} for i in places}
        searches = [_Search(i, 0.0, 0.0, 0, sorted({r for p in at for r in (
            math.floor(p), math.ceil(p))}), True) for i, at in places.items()]
        while searches:
            buckets = _count(numbers, searches)
            searches = [s for k, search in enumerate(searches)
                        for s in search.narrowed(buckets[k], values[search.column])]
        for i in chunk:
            result[columns[i]] = [
                _between(values[i][math.floor(p)], values[i][math.ceil(p)], p % 1)
                for p in places[i]] if i in places else [None] * len(shares)
    return result


def _between(low: float, high: float, part: float) -> float:
    return low if low == high or not part else low * (1 - part) + high * part


# ---- outliers -----------------------------------------------------------------------------------

@dataclass
class OutlierState:
    """First and third quartile of every column that has values in training."""

    quartiles: dict[str, list[float]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> OutlierState:
        return cls(**json.loads(text))

    def fences(self, column: str, factor: float = MILD) -> tuple[float, float]:
        first, third = self.quartiles[column]
        return first - factor * (third - first), third + factor * (third - first)


def fit_outliers(train: DataFrame, columns: Sequence[str]) -> OutlierState:
    """Quartiles of the training rows; a column without values has none, and so no outliers.

    NaN, infinite values and text that is no number are neither counted nor outliers.
    """
    found = exact_quantiles(train, columns, (0.25, 0.75))
    return OutlierState({c: q for c, q in found.items() if q[0] is not None})


def _beyond(df: DataFrame, state: OutlierState, column: str, factor: float) -> Column:
    low, high = state.fences(column, factor)
    x = finite_double(quoted(column), df.schema[column].dataType)
    return F.coalesce((x < low) | (x > high), F.lit(False))


def outlier_report(df: DataFrame, state: OutlierState) -> DataFrame:
    """(column, q1, q3, low, high, outliers, extreme) in one pass; extreme ones are outliers too."""
    names = list(state.quartiles)
    if not names:
        return df.sparkSession.range(0).selectExpr(
            "'' AS column", "0D AS q1", "0D AS q3", "0D AS low", "0D AS high", "0L AS outliers",
            "0L AS extreme")
    counts = df.agg(*[
        F.count(F.when(_beyond(df, state, c, factor), 1)).alias(f"{name}{i}")
        for i, c in enumerate(names) for name, factor in (("m", MILD), ("e", EXTREME))])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), *[F.lit(float(v)).alias(n) for n, v in zip(
            ("q1", "q3", "low", "high"), (*state.quartiles[c], *state.fences(c)))],
        F.col(f"m{i}").alias("outliers"), F.col(f"e{i}").alias("extreme"))
        for i, c in enumerate(names)])))


def treat_outliers(df: DataFrame, state: OutlierState, actions: Mapping[str, str],
                   factor: float = MILD) -> DataFrame:
    """The rows after the action of every named column, judged by their values before all actions.

    keep: nothing; flag: a column `<name>__outlier`, 1 or 0; clip: to the fence, as a double; null: the
    cell is emptied; drop: the row goes, if it is an outlier in any column to drop, which is meant for
    training rows. Columns that are not named are kept. A projection and a filter, no shuffle.
    """
    for column, action in actions.items():
        if action not in ACTIONS:
            raise M.PreparationError(f"no such action on outliers: {action}")
        if column not in df.columns:
            raise M.PreparationError(f"no such column: {column}")
    known = {c.lower() for c in df.columns}
    taken = [c for c, a in actions.items() if a == FLAG and (c + SUFFIX).lower() in known]
    if taken:
        raise M.PreparationError("flagged already: " + ", ".join(taken))

    def beyond(column: str) -> Column:
        return _beyond(df, state, column, factor) if column in state.quartiles else F.lit(False)

    cells, flags = [], []
    for name in df.columns:
        value, action = quoted(name), actions.get(name, KEEP)
        if action == FLAG:
            flags.append(beyond(name).cast("int").alias(name + SUFFIX))
        elif action == EMPTY:
            value = F.when(~beyond(name), value)
        elif action == CLIP and name in state.quartiles:
            x = value.cast("double") if not _is_text(df, name) else value.try_cast("double")
            low, high = state.fences(name, factor)
            value = F.when(beyond(name), F.when(x < low, F.lit(low)).otherwise(F.lit(high))).otherwise(x)
        cells.append(value.alias(name))
    dropped = [c for c, a in actions.items() if a == DROP]
    kept = df
    for name in dropped:
        kept = kept.where(~beyond(name))
    return kept.select(*cells, *flags)


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("string", "varchar", "char")
