"""Short codes for vectors: every part of a vector becomes the number of its nearest codebook entry.

Components are integers, so distances are exact. The nearest entry is found with pivots: a few
fixed points per part position, to which the distance of every part is computed once and stored.
In each round only the distances between pivots and entries are new; the difference of the two
distances to a pivot is a lower bound of the distance between part and entry. A part is compared
with entries in the order of their bounds, and only with those whose bound is not above the least
distance found so far.

A round is one pass over the stored parts: tasks return counts and sums per entry, which Spark adds
up; the driver sees the codebooks alone, whose size does not depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import named
from furrow.session import materialize, ship_package

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 16, 64, 2, 4, 256
# Integers above this would not leave 64 bits to the sum of a thousand million squares.
LARGEST = 1 << 26
# Entries that are compared one after the other, by their bounds, before all that are left.
IN_ORDER = 4
# Vectors that a task works on at once.
BLOCK = 8_192


@dataclass
class Codebooks:
    """`entries`: parts x entries x components; `pivots`: parts x pivots x components."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        numbers = ",".join(map(str, self.entries.ravel().tolist()))
        return hashlib.sha256(numbers.encode()).hexdigest()


def choose_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Of every part's first entries some that lie far apart, each as far as can be from the others.

    They stay as they are while the entries move. Ties go to the lower index.
    """
    chosen = []
    for part in entries:
        found = [0]
        nearest = ((part - part[0]) ** 2).sum(axis=1)
        while len(found) < min(pivots, len(part)):
            found.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((part - part[found[-1]]) ** 2).sum(axis=1))
        chosen.append(part[found])
    return np.array(chosen)


def squared(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every point."""
    return ((parts[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray,
            pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row the nearest entry, ties to the lower index, its squared distance, and evaluations.

    `to_pivots` are the squared distances of the rows to the pivots.
    """
    far = np.sqrt(to_pivots.astype(np.float64))
    between = np.sqrt(squared(entries, pivots).astype(np.float64))
    bound = np.abs(far[:, :1] - between[None, :, 0])
    for k in range(1, far.shape[1]):
        np.maximum(bound, np.abs(far[:, k:k + 1] - between[None, :, k]), out=bound)
    # Two roots and their difference are off by less than this.
    slack = 1e-14 * (far.max(axis=1, initial=0) + between.max(initial=0)) + 1e-12
    best = np.zeros(len(parts), np.int64)
    distance = np.full(len(parts), np.iinfo(np.int64).max)
    evaluated = 0
    rows = np.arange(len(parts))
    # First the entry of the lowest bound, then that of the next one, for a few turns.
    for _ in range(IN_ORDER):
        entry = bound[rows].argmin(axis=1)
        limit = np.sqrt(distance[rows].astype(np.float64)) * (1 + 1e-14) + slack[rows]
        left = bound[rows, entry] <= limit
        rows, entry = rows[left], entry[left]
        _improve(parts, entries, rows, entry, best, distance)
        bound[rows, entry] = np.inf
        evaluated += len(rows)
    limit = np.sqrt(distance[rows].astype(np.float64)) * (1 + 1e-14) + slack[rows]
    row, entry = np.nonzero(bound[rows] <= limit[:, None])
    if len(row):
        evaluated += len(row)
        exact = ((parts[rows[row]] - entries[entry]) ** 2).sum(axis=1)
        order = np.lexsort((entry, exact, row))
        some, first = np.unique(row[order], return_index=True)
        _improve(parts, entries, rows[some], entry[order][first], best, distance)
    return best, distance, evaluated


def _improve(parts: np.ndarray, entries: np.ndarray, rows: np.ndarray, entry: np.ndarray,
             best: np.ndarray, distance: np.ndarray) -> None:
    """Take these entries for these rows where they are nearer, or as near with a lower index."""
    exact = ((parts[rows] - entries[entry]) ** 2).sum(axis=1)
    nearer = (exact < distance[rows]) | ((exact == distance[rows]) & (entry < best[rows]))
    best[rows[nearer]], distance[rows[nearer]] = entry[nearer], exact[nearer]


# ---- the table ----------------------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str,
                    label_col: str) -> DataFrame:
    """(vec_id, label, v): components as floor(SCALE * x), of vectors that are finite throughout."""
    value = named(vector_col)
    wrong = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(value.isNotNull() & ~wrong).select(
        named(id_col).alias("vec_id"), named(label_col).alias("label"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def with_pivots(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """`vectors` with the squared distances of every part to its position's pivots."""
    parts, count, _ = pivots.shape
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            column = block.column("v")
            sizes = column.value_lengths().to_numpy()
            if (sizes != width).any():
                raise ValueError(f"vectors have {width} components, one has "
                                 f"{sizes[sizes != width][0]}")
            v = _matrix(column, width)
            if len(v) and np.abs(v).max(initial=0) > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST // SCALE}")
            split = v.reshape(len(v), parts, -1)
            far = np.concatenate([squared(split[:, j], pivots[j]) for j in range(parts)], axis=1)
            ends = pa.array(np.arange(len(v) + 1) * (parts * count), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))],
                [*block.schema.names, "far"])

    return vectors.mapInArrow(measure, f"vec_id {kind['vec_id']}, label {kind['label']}, "
                                       "v array<long>, far array<long>")


def _assign(block: pa.RecordBatch, books: Codebooks, width: int) -> tuple[np.ndarray, ...]:
    """Parts of a block, their entries and squared distances, all by row and part."""
    parts, count = books.pivots.shape[:2]
    v = _matrix(block.column("v"), width).reshape(block.num_rows, parts, -1)
    far = _matrix(block.column("far"), parts * count).reshape(len(v), parts, count)
    found = [nearest(v[:, j], far[:, j], books.entries[j], books.pivots[j])[:2]
             for j in range(parts)]
    return v, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def moved(stored: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks after one round: every entry the floor of the mean of its parts."""
    parts, entries, length = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, length + 1), dtype=np.int64)
        for block in _blocks(batches):
            v, code, _ = _assign(block, books, width)
            for j in range(parts):
                at = code[:, j] + j * entries
                np.add.at(total[:, 0], at, 1)
                for c in range(length):
                    np.add.at(total[:, c + 1], at, v[:, j, c])
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(c) for c in total[used].T)],
            ["entry", "n", *(f"s{c}" for c in range(length))])

    columns = ["n", *(f"s{c}" for c in range(length))]
    added = stored.select("v", "far").mapInArrow(
        sums, "entry long, " + ", ".join(f"{c} long" for c in columns))
    # One row per entry: parts x entries of them, whatever the table's size.
    after = books.entries.reshape(parts * entries, length).copy()
    for row in added.groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        after[row["entry"]] = [row[f"s{c}"] // row["n"] for c in range(length)]
    return Codebooks(after.reshape(books.entries.shape), books.pivots)


def coded(stored: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """(vec_id, label, code, error) under these codebooks."""
    kind = {f.name: f.dataType.simpleString() for f in stored.schema}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            _, code, distance = _assign(block, books, width)
            yield pa.RecordBatch.from_arrays(
                [block.column("vec_id"), block.column("label"),
                 pa.array([row.tobytes().hex() for row in code.astype(np.uint8)], pa.string()),
                 pa.array(distance.sum(axis=1), pa.int64())],
                ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(assign, f"vec_id {kind['vec_id']}, label {kind['label']}, "
                                     "code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """One row per finite vector: vec_id, code, error, label_error, codebooks_sha256.

    Codebooks start as the parts of the vectors of the `entries` smallest ids (null ids last, equal
    ids by their components), are moved `rounds` times and then stand. `code` holds the entry of
    every part, two hex digits each, `error` the squared distances, `label_error` their sum over
    equal labels, nulls together. Null vectors and those with a null, NaN or infinite component
    are left out; repeated rows count and come out as often as they are there; with fewer vectors
    than entries every vector is one; an empty table gives an empty result. Other columns are not
    read. All vectors have to have the same number of components, a multiple of `parts`, none
    beyond 262,144 in size, else the run fails with a message.
    """
    ship_package(vectors.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    rows = integer_vectors(vectors, id_col, vector_col, label_col)
    # At most `entries` rows, found as a top-k.
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(
        entries).collect()]
    if not first:
        return rows.where("false").select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = len(first[0])
    if width == 0 or width % parts or any(len(v) != width for v in first):
        raise ValueError(f"vectors cannot be cut into {parts} equal parts")
    start = np.array(first, dtype=np.int64)
    if np.abs(start).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST // SCALE}")
    start = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    books = Codebooks(start, choose_pivots(start, pivots))
    stored = materialize(with_pivots(rows, books.pivots, width), "codes-parts")
    for _ in range(rounds):
        books = moved(stored, books, width)
    found = materialize(coded(stored, books, width), "codes-coded")
    sums = materialize(found.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("of"), "label_error"), "codes-labels")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
