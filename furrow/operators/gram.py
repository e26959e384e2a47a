"""Correlations of all pairs of numeric columns, and principal components.

Every task adds up the products of its own rows for pairs of blocks of columns and hands on one row
per pair of columns; these are then grouped by pair. So a shuffle holds as many rows as there are
pairs and tasks, whatever the number of rows of the table. Values are centred on the column means of
a first pass, so that the sums lose no digits to a large mean. The order in which partial sums meet
is not fixed, so the last digits of a result may differ between runs.

Components are found by subspace iteration on the stored matrix of pairs. What reaches the driver is
a block of `components + SPARE` numbers per column, never the matrix and never rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import finite_double, quoted
from furrow.operators.fit import numeric_facts
from furrow.session import materialize, ship_package, small_table

# Columns of one block, and pairs of blocks that a pass keeps in a task (2.5 KB * BLOCK each).
BLOCK = 64
BLOCK_PAIRS_A_PASS = 160
THRESHOLD = 0.95
# Directions carried beyond the wanted components; they speed up convergence.
SPARE = 8
TOLERANCE = 1e-9
MOST_ROUNDS = 300

_PARTIAL = "a int, b int, n long, s_a double, s_b double, q_a double, q_b double, p double"
_SUMS = ("n", "s_a", "s_b", "q_a", "q_b", "p")


# ---- sums over pairs ----------------------------------------------------------------------------

def _task_sums(blocks: Sequence[tuple[int, int]], width: int):
    """A function for mapInArrow: sums of one task for these pairs of blocks of columns."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            present = np.isfinite(x)
            x = np.where(present, x, 0.0)
            here = present.astype(np.float64)
            for i, j in blocks:
                left = slice(i * width, (i + 1) * width)
                right = slice(j * width, (j + 1) * width)
                a, b, m_a, m_b = x[:, left], x[:, right], here[:, left], here[:, right]
                sums = [m_a.T @ m_b, a.T @ m_b, m_a.T @ b, (a * a).T @ m_b, m_a.T @ (b * b), a.T @ b]
                if (i, j) in totals:
                    for total, more in zip(totals[i, j], sums):
                        total += more
                else:
                    totals[i, j] = sums
        for (i, j), sums in totals.items():
            a, b = np.indices(sums[0].shape)
            a, b = a.ravel() + i * width, b.ravel() + j * width
            kept = a <= b
            columns = [a[kept].astype(np.int32), b[kept].astype(np.int32)]
            columns += [s.ravel()[kept] for s in sums]
            columns[2] = columns[2].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["a", "b", *_SUMS])

    return add_up


def pair_sums(df: DataFrame, columns: Sequence[str], means: Mapping[str, float],
              block: int = BLOCK) -> DataFrame:
    """(a, b, n, s_a, s_b, q_a, q_b, p) for a <= b, stored: rows where both columns are present, and
    over these the sums of both, of both squares and of the products, all less the given means."""
    ship_package(df.sparkSession)
    types = {f.name: f.dataType for f in df.schema}
    centred = df.select(*[
        (finite_double(quoted(c), types[c]) - F.lit(float(means[c] or 0.0))).alias(f"c{i}")
        for i, c in enumerate(columns)])
    count = -(-len(columns) // block)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    sums = None
    for start in range(0, len(pairs), BLOCK_PAIRS_A_PASS):
        some = pairs[start:start + BLOCK_PAIRS_A_PASS]
        used = sorted({k for pair in some for k in pair})
        # A pass reads the columns of its blocks only.
        names = [c for k in used for c in centred.columns[k * block:(k + 1) * block]]
        local = [(used.index(i), used.index(j)) for i, j in some]
        part = centred.select(*names).mapInArrow(_task_sums(local, block), _PARTIAL)
        numbers = F.array(*[F.lit(int(n[1:])) for n in names])
        part = part.select(F.get(numbers, F.col("a")).alias("a"),
                           F.get(numbers, F.col("b")).alias("b"), *_SUMS)
        sums = part if sums is None else sums.unionAll(part)
    return materialize(sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS]), "gram")


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    if not columns:
        raise M.PreparationError("no numeric columns")
    return numeric_facts(df, columns, median=False)


# ---- correlation --------------------------------------------------------------------------------

def correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(a, b, rows, r) of all pairs of columns in their given order, over rows with both values.

    Text that is no number, NaN and infinite values count as missing. r is null where fewer than two
    rows have both values or one of the columns is constant over these rows. An empty table has no
    pairs.
    """
    facts = _means(df, columns)
    sums = pair_sums(df, columns, {c: f["mean"] for c, f in facts.items()}, block).where("a < b")
    n = F.col("n")
    left = F.col("q_a") - F.col("s_a") * F.col("s_a") / n
    right = F.col("q_b") - F.col("s_b") * F.col("s_b") / n
    # A constant column leaves nothing but rounding.
    varied = ((n >= 2) & (left > F.col("q_a") * 1e-13) & (right > F.col("q_b") * 1e-13))
    r = (F.col("p") - F.col("s_a") * F.col("s_b") / n) / F.sqrt(left) / F.sqrt(right)
    names = F.array(*map(F.lit, columns))
    return sums.select(
        F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), n.alias("rows"),
        F.when(varied, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))


def high_correlations(df: DataFrame, columns: Sequence[str],
                      threshold: float = THRESHOLD) -> DataFrame:
    """The pairs of `correlations` whose r is at least `threshold`, or at most its negative."""
    if not 0 < threshold <= 1:
        raise M.PreparationError("the threshold lies above 0 and is 1 at most")
    return correlations(df, columns).where(F.abs("r") >= threshold)


# ---- principal components -----------------------------------------------------------------------

@dataclass
class Components:
    """Means, scales and loadings learned from the training rows."""

    columns: list[str]
    means: list[float]
    scales: list[float]
    # One list of loadings per component, in the order of the columns.
    loadings: list[list[float]]
    variances: list[float]
    total_variance: float
    rounds: int

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Components:
        return cls(**json.loads(text))

    def table(self, spark) -> DataFrame:
        """(component, column, loading, variance, share), components counted from 1."""
        return small_table(spark, [
            (k + 1, c, self.loadings[k][i], v, v / self.total_variance)
            for k, v in enumerate(self.variances) for i, c in enumerate(self.columns)],
            "component int, column string, loading double, variance double, share double")


def _times(pairs: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix of pairs times a block of vectors; one row per column reaches the driver."""
    spark = pairs.sparkSession
    vectors = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(block)], "j int, v array<double>")
    both = pairs.select(F.inline(F.filter(F.array(
        F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.col("value").alias("value")),
        F.struct(F.col("b").alias("i"), F.col("a").alias("j"), F.when(
            F.col("a") != F.col("b"), F.col("value")).alias("value"))),
        lambda x: x["value"].isNotNull())))
    sums = both.join(vectors, "j").groupBy("i").agg(*[
        F.sum(F.col("value") * F.col("v")[k]).alias(f"y{k}") for k in range(block.shape[1])])
    result = np.zeros_like(block)
    for r in sums.collect():
        result[r["i"]] = [r[f"y{k}"] for k in range(block.shape[1])]
    return result


def fit_components(train: DataFrame, columns: Sequence[str], components: int,
                   standardize: bool = True, tolerance: float = TOLERANCE,
                   most_rounds: int = MOST_ROUNDS) -> Components:
    """The directions of greatest variance of the training rows, by subspace iteration.

    Missing values (text that is no number, NaN and infinite values too) take the column's mean. With
    `standardize`, columns are divided by their deviation after that; a constant column has the scale
    1 and no loading. The variance is the population's. It stops when the residual of every wanted
    component is at most `tolerance` times the greatest variance, and fails if that takes more than
    `most_rounds`. The loading of greatest size is positive (the first of several equal ones).
    Components of equal variance are some basis of their space.
    """
    columns = list(columns)
    facts = _means(train, columns)
    empty = [c for c in columns if not facts[c]["present"]]
    if empty:
        raise M.PreparationError("no value in the training rows in: " + ", ".join(empty))
    size = len(columns)
    if not 1 <= components <= size:
        raise M.PreparationError(f"between 1 and {size} components can be asked for")
    rows = facts[columns[0]]["rows"]
    sums = pair_sums(train, columns, {c: f["mean"] for c, f in facts.items()})
    # Missing cells add nothing to centred products, so the sum over present pairs is the whole one.
    variance = {c: facts[c]["variance"] * facts[c]["present"] / rows for c in columns}
    constant = {c for c in columns if facts[c]["low"] == facts[c]["high"]}
    scales = [float(variance[c] ** 0.5) if standardize and c not in constant else 1.0 for c in columns]
    scale = F.array(*map(F.lit, scales))
    live = F.array(*[F.lit(c not in constant) for c in columns])
    pairs = materialize(sums.where(F.get(live, F.col("a")) & F.get(live, F.col("b"))).select(
        "a", "b", (F.col("p") / F.lit(float(rows)) / F.get(scale, F.col("a"))
                   / F.get(scale, F.col("b"))).alias("value")), "covariance")
    total = pairs.where("a = b").agg(F.coalesce(F.sum("value"), F.lit(0.0))).head()[0]
    if total <= 0:
        raise M.PreparationError("all columns are constant")
    varied = size - len(constant)
    if components > varied:
        raise M.PreparationError(f"only {varied} columns vary")
    width = min(varied, components + SPARE)
    # Fixed starting directions, so that reruns take the same way.
    start = np.random.default_rng(size).standard_normal((size, width))
    still = [i for i, c in enumerate(columns) if c in constant]
    start[still] = 0.0
    basis, _ = np.linalg.qr(start)
    for done in range(1, most_rounds + 1):
        image = _times(pairs, basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        vectors, image = basis @ turn, image @ turn
        residual = np.linalg.norm(image - vectors * values, axis=0)[:components]
        if residual.max() <= tolerance * values[0]:
            break
        basis, _ = np.linalg.qr(image)
    else:
        raise M.PreparationError(f"components did not settle in {most_rounds} rounds")
    vectors = vectors[:, :components]
    vectors[still] = 0.0
    largest = np.abs(vectors) >= np.abs(vectors).max(axis=0) - 1e-9
    signs = np.sign(vectors[largest.argmax(axis=0), range(components)])
    return Components(columns, [float(facts[c]["mean"]) for c in columns], scales,
                      (vectors * signs).T.tolist(), np.maximum(values[:components], 0.0).tolist(),
                      float(total), done)


def project(df: DataFrame, fitted: Components, prefix: str = "pc") -> DataFrame:
    """The rows with one more column per component, a projection without a shuffle."""
    names = [f"{prefix}{k + 1}" for k in range(len(fitted.loadings))]
    known = {c.lower() for c in df.columns}
    taken = [n for n in names if n.lower() in known]
    if taken:
        raise M.PreparationError("these columns exist already: " + ", ".join(taken))
    types = {f.name: f.dataType for f in df.schema}
    centred = [F.coalesce((finite_double(quoted(c), types[c]) - mean) / scale, F.lit(0.0))
               for c, mean, scale in zip(fitted.columns, fitted.means, fitted.scales)]
    cells = F.array(*centred)
    scores = df.withColumn("_cells", cells)
    return scores.withColumns({
        name: F.aggregate(F.zip_with("_cells", F.array(*map(F.lit, loading)), lambda x, w: x * w),
                          F.lit(0.0), lambda total, x: total + x)
        for name, loading in zip(names, fitted.loadings)}).drop("_cells")
