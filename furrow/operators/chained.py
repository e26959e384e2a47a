"""Missing numbers filled by chained ridge models: every incomplete column from all the others.

Values are put on the scale of the training part, holes start at its mean, and in every round each
incomplete column gets a ridge model over the rows that have it. The sums of squares and products of
all models of a round come from one aggregation: a task adds up its own rows and hands on one row per
pair of columns and model. The holes of a row depend on that row and the models alone, so no filled
table is stored between rounds: a task applies the models of the rounds so far and goes on.

Within a round the holes of a row are filled one column after the other, each from the values before
it in the same round. What reaches the driver is a matrix per incomplete column, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import finite_double, quoted
from furrow.operators.fit import numeric_facts
from furrow.session import materialize, ship_package

ROUNDS = 10
TOLERANCE = 1e-4
PENALTY = 1e-3
# A round brings one matrix per incomplete column to the driver: 64 of 64 x 64 numbers at most.
MOST_COLUMNS = 64


@dataclass
class ChainedState:
    """Scale of every column, and the models of all rounds in the order they are applied."""

    columns: list[str]
    means: list[float]
    scales: list[float]
    # Places of the columns that have models, in the order in which holes are filled.
    incomplete: list[int]
    # Per round and incomplete column: the weights of all columns (its own is 0), then the constant.
    rounds: list[list[list[float]]]
    # Greatest change of a weight or constant from the round before, per round.
    changes: list[float]
    converged: bool

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ChainedState:
        return cls(**json.loads(text))


def _fill(z: np.ndarray, missing: np.ndarray, incomplete: Sequence[int], rounds: Sequence) -> None:
    """Put the values of these rounds into the holes of z, which are zero before."""
    for models in rounds:
        for j, weights in zip(incomplete, models):
            holes = missing[:, j]
            if holes.any():
                w = np.asarray(weights)
                z[holes, j] = z[holes] @ w[:-1] + w[-1]


def _task_sums(incomplete: Sequence[int], rounds: Sequence):
    """A function for mapInArrow: per model the products of all pairs of columns, and of each with 1."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            missing = ~np.isfinite(z)
            z[missing] = 0.0
            _fill(z, missing, incomplete, rounds)
            with_one = np.column_stack([z, np.ones(len(z))])
            sums = np.stack([rows.T @ rows for rows in (
                with_one[~missing[:, j]] for j in incomplete)])
            totals = sums if totals is None else totals + sums
        if totals is not None:
            places = [p.ravel() for p in np.indices(totals.shape)]
            kept = places[1] <= places[2]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(p[kept].astype(np.int32)) for p in places],
                 pa.array(totals.ravel()[kept])], names=["model", "a", "b", "p"])

    return add_up


def _solve(products: np.ndarray, j: int, penalty: float) -> np.ndarray:
    """Ridge weights of column j from the products over its rows; the constant is not penalised."""
    n, sums = products[-1, -1], products[-1, :-1]
    centred = products[:-1, :-1] - np.outer(sums, sums) / n
    others = [i for i in range(len(sums)) if i != j]
    left = centred[np.ix_(others, others)] + penalty * n * np.eye(len(others))
    weights = np.zeros(len(sums) + 1)
    weights[others] = np.linalg.solve(left, centred[others, j])
    weights[-1] = (sums[j] - weights[:-1] @ sums) / n
    return weights


def fit_chained(train: DataFrame, columns: Sequence[str], rounds: int = ROUNDS,
                tolerance: float = TOLERANCE, penalty: float = PENALTY) -> ChainedState:
    """Models of every column of the training rows, also of those that have no hole there.

    It stops when no weight and no constant changed by more than `tolerance` from the round before (on
    the scale of deviations), or after `rounds`; `converged` tells which. The penalty is per row, on
    values less their mean and divided by their deviation (1 for a constant column). Null, NaN,
    infinite values and text that is no number are holes. A column without values and an empty table
    are refused, and so are fewer than two columns or more than `MOST_COLUMNS`. Repeated rows count as
    often as they occur. The order of sums is not fixed, so last digits may differ between runs.
    """
    names = list(columns)
    if not 2 <= len(names) <= MOST_COLUMNS:
        raise M.PreparationError(f"chained models take 2 to {MOST_COLUMNS} columns")
    if len(set(names)) != len(names):
        raise M.PreparationError("a column is named twice")
    if rounds < 1 or penalty <= 0:
        raise M.PreparationError("at least one round and a penalty above 0 are needed")
    facts = numeric_facts(train, names, median=False)
    empty = [c for c in names if not facts[c]["present"]]
    if empty:
        raise M.PreparationError("no value in the training rows: " + ", ".join(empty))
    means = [float(facts[c]["mean"]) for c in names]
    # The rounding of equal values is no variation.
    scales = [float(np.sqrt(facts[c]["variance"])) if facts[c]["low"] < facts[c]["high"] else 1.0
              for c in names]
    ship_package(train.sparkSession)
    types = {f.name: f.dataType for f in train.schema}
    # Stored once, these columns alone, because every round reads them.
    scaled = materialize(train.select(*[
        ((finite_double(quoted(c), types[c]) - F.lit(means[i])) / F.lit(scales[i])).alias(f"c{i}")
        for i, c in enumerate(names)]), "chained")
    # Incomplete columns first have fewest holes; columns without any come last, for later tables.
    order = sorted(range(len(names)), key=lambda i: (
        facts[names[i]]["present"] == facts[names[i]]["rows"], -facts[names[i]]["present"], i))
    state = ChainedState(names, means, scales, order, [], [], False)
    size = len(names) + 1
    while len(state.rounds) < rounds and not state.converged:
        found = scaled.mapInArrow(
            _task_sums(order, state.rounds), "model int, a int, b int, p double").groupBy(
            "model", "a", "b").agg(F.sum("p").alias("p")).collect()
        products = np.zeros((len(order), size, size))
        for r in found:
            products[r["model"], r["a"], r["b"]] = products[r["model"], r["b"], r["a"]] = r["p"]
        models = [_solve(products[k], j, penalty).tolist() for k, j in enumerate(order)]
        if state.rounds:
            state.changes.append(float(np.max(np.abs(
                np.asarray(models) - np.asarray(state.rounds[-1])))))
            state.converged = state.changes[-1] <= tolerance
        state.rounds.append(models)
    return state


def impute_chained(df: DataFrame, state: ChainedState) -> DataFrame:
    """All rows and columns of `df`, with the state's columns as doubles without holes.

    Present values stay as they are. A row without any present value gets what the models make of the
    means. Other columns do not pass through Python, and an empty table stays empty.
    """
    lost = [c for c in state.columns if c not in df.columns]
    if lost:
        raise M.PreparationError("no such column: " + ", ".join(lost))
    ship_package(df.sparkSession)
    types = {f.name: f.dataType for f in df.schema}
    values = [finite_double(quoted(c), types[c]) for c in state.columns]
    means, scales = np.asarray(state.means), np.asarray(state.scales)
    incomplete, rounds = state.incomplete, state.rounds

    @F.pandas_udf("array<double>")
    def filled(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return cells
        x = np.array([np.asarray(c, dtype=float) for c in cells])
        missing = ~np.isfinite(x)
        z = (x - means) / scales
        z[missing] = 0.0
        _fill(z, missing, incomplete, rounds)
        return pd.Series(list(z * scales + means))

    hole = _unused(df.columns)
    complete = values[0].isNotNull()
    for v in values[1:]:
        complete = complete & v.isNotNull()
    # Rows without a hole hand Python an array of zeros that is not looked at.
    sent = F.when(complete, F.array_repeat(F.lit(0.0), len(values))).otherwise(
        F.transform(F.array(*values), lambda v: F.coalesce(v, F.lit(float("nan")))))
    places = {c: i for i, c in enumerate(state.columns)}

    def cell(name: str) -> Column:
        if name not in places:
            return quoted(name)
        i = places[name]
        return F.coalesce(values[i], F.col(hole)[i]).alias(name)

    return df.withColumn(hole, filled(sent)).select(*[cell(c) for c in df.columns])


def _unused(names: Sequence[str]) -> str:
    """A name that none of the columns has."""
    name = "_filled"
    while name in {n.lower() for n in names}:
        name += "_"
    return name
