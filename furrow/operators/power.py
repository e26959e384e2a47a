"""Yeo-Johnson transformation: the exponent of greatest likelihood, learned from training rows.

A pass over the rows gives the log-likelihood of a whole grid of exponents for many columns at once;
the next grid lies between the neighbours of the best one. Tasks work on batches of rows as arrays and
hand on one row per column and exponent. All further rows are transformed by a projection with the
stored exponents.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import finite_double, quoted
from furrow.operators.fit import numeric_facts
from furrow.session import materialize, ship_package, small_table

LOW, HIGH = -5.0, 5.0
GRID = 21
TOLERANCE = 1e-6
COLUMNS_PER_PASS = 24
# Powers closer to 0 than this give the logarithm, their limit.
NEAR = 1e-9
# From this size of the power on, values of one sign are kept without the formula's constant, which
# would swallow the digits of tiny spreads: 100,000 ** -5 is lost beside 1.
BARE = 1e-3


def yeo_johnson(x: Column, exponent: float) -> Column:
    """x transformed with this exponent; null stays null."""
    def branch(size: Column, power: float) -> Column:
        logs = F.log1p(size)
        return logs if abs(power) < NEAR else F.expm1(logs * power) / power

    return F.when(x >= 0, branch(x, exponent)).otherwise(-branch(-x, 2.0 - exponent))


def _scaled(logs: np.ndarray, power: float, shift: float, one_sided: bool) -> np.ndarray:
    """The size of the transformed values of these logarithms; for columns of one sign, and powers from
    BARE on, less its constant and divided by exp(power * shift)."""
    if abs(power) < NEAR:
        return logs
    if one_sided and abs(power) >= BARE:
        return np.exp(power * (logs - shift)) / power
    return np.expm1(power * logs) / power


def _spread(y: np.ndarray) -> tuple[int, float, float]:
    """Count, mean, and sum of squares about the mean; the latter is 0 if all are equal."""
    apart = y - y[0]
    middle = apart.mean()
    return len(y), float(y[0] + middle), float(np.square(apart - middle).sum())


def _together(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """The same of both sets of values."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


def _spreads(df: DataFrame, grids: Mapping[str, Sequence[float]], shifts: Mapping[str, float],
             one_sided: Mapping[str, bool]) -> DataFrame:
    """(column, exponent, n, variance) of the transformed present values."""
    ship_package(df.sparkSession)
    types = {f.name: f.dataType for f in df.schema}
    names = list(grids)
    grids = {c: [float(e) for e in grids[c]] for c in names}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, float], tuple[int, float, float]] = {}
        for batch in batches:
            for i, c in enumerate(names):
                x = batch.column(i).drop_null().to_numpy()
                if not len(x):
                    continue
                up, down = np.log1p(x[x >= 0]), np.log1p(-x[x < 0])
                for e in grids[c]:
                    # Strong powers of far values leave the range of doubles.
                    with np.errstate(all="ignore"):
                        own = _spread(np.concatenate([
                            _scaled(up, e, shifts[c], one_sided[c]),
                            -_scaled(down, 2.0 - e, shifts[c], one_sided[c])]))
                        found[c, e] = _together(found[c, e], own) if (c, e) in found else own
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in found], pa.string()), pa.array([e for _, e in found], pa.float64()),
             *[pa.array([v[k] for v in found.values()], kind)
               for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))]],
            ["column", "exponent", "n", "mean", "squares"])

    numbers = df.select(*[finite_double(quoted(c), types[c]).alias(f"x{i}")
                          for i, c in enumerate(names)])
    sums = numbers.mapInArrow(
        add_up, "column string, exponent double, n long, mean double, squares double")

    def merged(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(a["n"] == 0, b).otherwise(F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n).alias("squares")))

    # One entry per task.
    entries = F.collect_list(F.struct("n", "mean", "squares"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"),
                    F.lit(0.0).alias("squares"))
    return sums.groupBy("column", "exponent").agg(F.aggregate(entries, none, merged).alias("s")).select(
        "column", "exponent", "s.n", (F.col("s.squares") / F.col("s.n")).alias("variance"))


def log_likelihoods(df: DataFrame, exponents: Mapping[str, Sequence[float]],
                    facts: Mapping[str, Mapping[str, float]],
                    logs: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, exponent, log_likelihood) of the present values: one row per column and exponent.

    -n/2 * log(variance of the transformed values) + (exponent - 1) * sum(sign(x) * log(1 + |x|)),
    as it is maximal over mean and variance, less n/2 * (log(2 * pi) + 1). `facts` are the columns'
    `numeric_facts`, `logs` their `mean_logs` where the caller has them.
    """
    spark = df.sparkSession
    names = list(exponents)
    shifts = logs or mean_logs(df, names)
    result = _spreads(df, exponents, {c: float(shifts[c][0]) for c in names},
                      {c: facts[c]["low"] >= 0 or facts[c]["high"] <= 0 for c in names})
    # One row per column.
    known = small_table(spark, [
        (c, float(shifts[c][0]), float(shifts[c][1]), facts[c]["low"] >= 0, facts[c]["high"] <= 0)
        for c in names],
        "column string, shift double, signed double, up boolean, down boolean")
    power = F.when(F.col("up"), F.col("exponent")).otherwise(2.0 - F.col("exponent"))
    undone = F.when((F.col("up") | F.col("down")) & (F.abs(power) >= BARE),
                    2.0 * power * F.col("shift")).otherwise(0.0)
    value = (-F.col("n") / 2.0 * (F.log("variance") + undone)
             + (F.col("exponent") - 1.0) * F.col("signed"))
    return result.join(F.broadcast(known), "column").select(
        "column", "exponent", value.alias("log_likelihood"))


def mean_logs(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per column the mean of log(1 + |x|), and its sum with the sign of x."""
    types = {f.name: f.dataType for f in df.schema}
    found: dict[str, tuple[float, float]] = {}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[start:start + COLUMNS_PER_PASS]
        logs = [(F.log1p(F.abs(finite_double(quoted(c), types[c]))),
                 F.signum(finite_double(quoted(c), types[c]))) for c in chunk]
        row = df.agg(*[F.avg(size).alias(f"m{i}") for i, (size, _) in enumerate(logs)],
                     *[F.sum(size * sign).alias(f"s{i}") for i, (size, sign) in enumerate(logs)]
                     ).head()
        found.update({c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(chunk)})
    return found


@dataclass
class PowerState:
    """The exponent of every column, and how its training values are brought to mean 0, deviation 1.

    `sides` tells columns of one sign in training (1 not negative, -1 not positive, else 0); these are
    standardized in the form without the constant, so `centers` and `scales` belong to that form.
    """

    exponents: dict[str, float]
    sides: dict[str, int]
    shifts: dict[str, float]
    centers: dict[str, float]
    scales: dict[str, float]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> PowerState:
        return cls(**json.loads(text))

    def form(self, x: Column, name: str) -> Column:
        """The transformed value, up to a factor and a constant of the column."""
        exponent, side, shift = self.exponents[name], self.sides[name], self.shifts[name]
        plain = yeo_johnson(x, exponent)
        power = exponent if side > 0 else 2.0 - exponent
        if not side or abs(power) < BARE:
            return plain
        logs = F.log1p(F.abs(x))
        usual = side * F.exp(power * (logs - shift)) / power
        # Values of the other sign, new to the column.
        other = (plain + side / power) * math.exp(-power * shift)
        return F.when(x * side >= 0, usual).otherwise(other)


def fit_yeo_johnson(train: DataFrame, columns: Sequence[str], low: float = LOW,
                    high: float = HIGH, grid: int = GRID,
                    tolerance: float = TOLERANCE) -> PowerState:
    """The exponent of greatest likelihood of each column, within `tolerance`, between low and high.

    Missing values, NaN, infinite values and text that is no number are left out. Columns that are
    empty or constant keep the exponent 1, which changes nothing. Equal likelihoods: the smaller one.
    """
    if not low < high or grid < 4 or tolerance <= 0:
        raise M.PreparationError("low < high, four exponents or more, and a tolerance above 0")
    types = {f.name: f.dataType for f in train.schema}
    # The passes to come read a stored table of numbers, not the steps that lead to the rows.
    train = materialize(train.select(*[
        finite_double(quoted(c), types[c]).alias(c) for c in columns]), "power")
    facts = numeric_facts(train, columns, median=False)
    logs = mean_logs(train, columns)
    exponents = dict.fromkeys(columns, 1.0)
    open_ = {c: (low, high) for c in columns
             if facts[c]["present"] and facts[c]["low"] < facts[c]["high"]}
    # A pass narrows every range by 2 / (grid - 1), so their number is known beforehand.
    passes = max(1, math.ceil(math.log((high - low) / tolerance) / math.log((grid - 1) / 2)))
    for _ in range(passes if open_ else 0):
        tried = {c: [a + (b - a) * k / (grid - 1) for k in range(grid)] for c, (a, b) in open_.items()}
        best: dict[str, tuple[float, float]] = {}
        # One row per column and exponent.
        for r in log_likelihoods(train, tried, facts, logs).collect():
            score = r["log_likelihood"]
            if score is not None and math.isfinite(score):
                best[r["column"]] = max(best.get(r["column"], (-math.inf, 0.0)),
                                        (score, -r["exponent"]))
        for c, (a, b) in list(open_.items()):
            if c not in best:
                open_.pop(c)
                continue
            exponents[c], step = -best[c][1], (b - a) / (grid - 1)
            open_[c] = (max(low, exponents[c] - step), min(high, exponents[c] + step))
    state = PowerState(exponents, {}, {c: logs[c][0] for c in columns}, {}, {})
    for c in columns:
        varied = bool(facts[c]["present"]) and facts[c]["low"] < facts[c]["high"]
        state.sides[c] = (varied and facts[c]["low"] >= 0) - (varied and facts[c]["high"] <= 0)
    moved = [state.form(quoted(c), c) for c in columns]
    row = train.agg(*[F.avg(y).alias(f"m{i}") for i, y in enumerate(moved)],
                    *[F.stddev_pop(y).alias(f"d{i}") for i, y in enumerate(moved)]).head()
    for i, c in enumerate(columns):
        state.centers[c] = row[f"m{i}"] or 0.0
        state.scales[c] = row[f"d{i}"] or 1.0
    return state


def apply_yeo_johnson(df: DataFrame, state: PowerState, standardize: bool = True) -> DataFrame:
    """The columns of the state transformed in place, a projection. Missing stays missing.

    Without `standardize` the plain formula is given, in which a strong exponent can round all values
    of a column far from zero to one.
    """
    types = {f.name: f.dataType for f in df.schema}
    cells = []
    for name in df.columns:
        value = quoted(name)
        if name in state.exponents:
            number = finite_double(value, types[name])
            value = ((state.form(number, name) - state.centers[name]) / state.scales[name]
                     if standardize else yeo_johnson(number, state.exponents[name]))
        cells.append(value.alias(name))
    return df.select(*cells)
