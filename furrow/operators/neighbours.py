"""Missing values from the nearest rows, found through cells of a tree.

A row's coordinates are its numbers, divided by their deviation, and its categories, which are one
apart if they differ. A row with holes is compared by the coordinates it has, its pattern, with the
rows that have these and the one to be filled (its donors). Equal donors are one donor, and equal rows
with holes are one question.

A tree cuts the space of all coordinates into cells, again and again at the median of the coordinate
that keeps rows furthest apart, those that rows with holes often lack counting less. Its cuts come from
a sample of at most SAMPLE donors, taken by their digests; every donor is put into its cell, and cells
that turn out too large are cut further. One set of cells serves all patterns. The donors of the sample
near a question give a distance that its neighbours cannot exceed; it visits every cell that is not
further away, measured by the coordinates of its pattern, so that what it finds is exact, unless there
are more such cells than it may visit: then it visits the nearest of them. A question that finds too few
donors asks again in more cells.

Rows and questions meet where both are dealt out by cell and sorted, once; a task holds one cell's donors
and a batch of questions. The donors of a cell are laid out as leaves of a tree of their own, one for
every frequent pattern, of its coordinates and its donors only, and one for all other patterns. A
question is compared, as arrays, with the donors of its own leaf and then of the leaves within the
distance known by then, nearest first, of COMPARED donors at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow import model as M
from furrow.functions.text import exact_text, finite_double, normalize_category, quoted
from furrow.operators.fit import vocabulary
from furrow.session import materialize, ship_package

NEIGHBOURS = 5
# Cells that a question may visit, and how many times more if it finds too few donors.
TABLES, MORE = 64, (1, 16)
# Donors that a cell holds on average: as many as let a question visit all cells, within these; and how
# many times as many it may hold before it is cut further.
BUCKETS, LARGE = (512, 32_768), 4
# Donors of which the tree is made, and how often its large cells are cut further.
SAMPLE, ROUNDS = 400_000, 4
# Columns up to which all rows of the sample are handed to the tasks.
WIDE = 8
# Categories of a column that cells can tell apart; the rest lie in one place.
LISTED = 1_000
# Rows of the sample in a cell from which on its size needs no counting.
SURE = 64
# Donors of a leaf; donors of a cell that a question is compared with at most, the more the nearer the
# cell; and those of the sample, which only say how far it has to look.
LEAF, COMPARED, SAMPLED = 32, 32_768, 4_096
# Leaves around a question that are looked into where its own has too few donors for a distance.
AROUND = 16
# Patterns that have leaves of their own: so many, of one in so many questions at least.
FREQUENT, FREQUENT_SHARE = 32, 64
# Distances computed at once, and donors that one task holds by and by.
AT_ONCE, DONORS_A_TASK = 1 << 20, 200_000
SEED = 42


@dataclass
class Coordinates:
    """The columns that count, their deviations, and what to fill where nothing is near."""

    numeric: list[str]
    categorical: list[str]
    means: list[float]
    deviations: list[float]
    fills: list[object]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def of(self, df: DataFrame) -> list[Column]:
        kinds = {f.name: f.dataType for f in df.schema}
        return [finite_double(quoted(c), kinds[c]) for c in self.numeric] + [
            normalize_category(quoted(c)) for c in self.categorical]


@dataclass
class Cells:
    """A tree of cuts: the axis of every node (-1 for a cell), its cut, its first child, its box.

    Places beyond the cut lie in the second child, the one after the first. `listed` are the categories
    of each categorical column in the order in which they lie on its axis.
    """

    listed: list[list[str]]
    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, z: np.ndarray) -> np.ndarray:
        """The cells of places."""
        node = np.zeros(len(z), np.int64)
        while (inner := np.flatnonzero(self.axis[node] >= 0)).size:
            at = node[inner]
            node[inner] = self.child[at] + (z[inner, self.axis[at]] > self.cut[at])
        return node

    def apart(self, z: np.ndarray, has: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances of places to boxes that no row inside falls below, by the axes in `has`."""
        off = np.maximum(np.maximum(self.low[node] - z, z - self.high[node]), 0.0)
        numbers = z.shape[1] - len(self.listed)
        off[:, numbers:] = off[:, numbers:] > 0
        return (np.square(off) * has).sum(axis=1)

    def near(self, z: np.ndarray, has: np.ndarray, limit: np.ndarray,
             most: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell): per place the cells up to the squared distance `limit`, `most` at most, the
        nearest first."""
        limit = _slack(limit)
        row, node = np.arange(len(z)), np.zeros(len(z), np.int64)
        while (inner := self.axis[node] >= 0).any():
            first = self.child[node[inner]]
            row = np.concatenate([row[~inner], row[inner], row[inner]])
            node = np.concatenate([node[~inner], first, first + 1])
            off = self.apart(z[row], has[row], node)
            row, node, off = _first(row, node, off, limit, most)
        order = np.lexsort((node, self.apart(z[row], has[row], node), row))
        return row[order], node[order]


def _slack(limit: np.ndarray) -> np.ndarray:
    """A squared distance that no rounding brings below `limit`."""
    return limit * (1 + 1e-9) + 1e-9


def _rank(row: np.ndarray) -> np.ndarray:
    """The place of every entry among those of its row; rows are sorted."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _first(row: np.ndarray, node: np.ndarray, off: np.ndarray, limit: np.ndarray,
           most: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of every row up to its limit, the nearest `most` if there are more."""
    kept = off <= limit[row]
    row, node, off = row[kept], node[kept], off[kept]
    if len(row) and (np.bincount(row, minlength=len(limit)) > most).any():
        order = np.lexsort((node, off, row))
        row, node, off = row[order], node[order], off[order]
        kept = _rank(row) < (most if isinstance(most, int) else most[row])
        row, node, off = row[kept], node[kept], off[kept]
    return row, node, off


class Leaves:
    """Donors in leaves of LEAF rows at most: a tree whose nodes are cut near the median of the coordinate
    that keeps their rows furthest apart. Boxes are those of the rows inside, by the coordinates that rows
    have.

    `y` has an axis per line, NaN where missing; the last ones, words as numbers, are one apart if they
    differ. `some` are the rows that count.
    """

    def __init__(self, y: np.ndarray, deviations: Sequence[float], axes: Sequence[int],
                 some: np.ndarray, weights: Sequence[float] | None = None):
        n, self.numbers, self.axes, self.deviations = len(some), len(deviations), list(axes), deviations
        z = np.array([y[i][some] for i in self.axes]).reshape(len(self.axes), n)
        weights = np.array([weights[i] if weights is not None else 1.0 for i in self.axes])
        words = np.array([i >= self.numbers for i in self.axes], bool)
        scales = [deviations[i] if i < self.numbers else 1.0 for i in self.axes]
        filled = np.array([np.nan_to_num((x - (np.nanmean(x) if not np.isnan(x).all() else 0.0)) / scale)
                           for x, scale in zip(z, scales)])
        order = np.arange(n)
        # Of the nodes of the last level: first row, row after the last; of all: boxes and first child.
        start, end, node = np.array([0]), np.array([n]), np.array([0])
        boxes = [self._boxes(z, np.array([0]))]
        child, leaf = [np.array([-1])], []
        while True:
            inner = end - start > LEAF
            leaf += zip(start[~inner].tolist(), end[~inner].tolist(), node[~inner].tolist())
            start, end, node = start[inner], end[inner], node[inner]
            if not len(start):
                break
            size = end - start
            first = np.cumsum(size) - size
            of = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(of)) - first[of] + start[of]
            row = order[place]
            wide = np.zeros((len(self.axes), len(size)))
            for j in range(len(self.axes)):
                x = filled[j][row]
                mean = np.add.reduceat(x, first) / size
                wide[j] = 2 * (np.add.reduceat(np.square(x), first) / size - np.square(mean))
                wide[j] = weights[j] * (np.minimum(wide[j], 1.0) if words[j] else wide[j])
            x = filled[wide.argmax(axis=0)[of], row] if len(self.axes) else np.zeros(len(of))
            by = np.lexsort((x, of))
            row, x = row[by], x[by]
            order[place] = row
            # Equal places stay together where there are others.
            half = first + size // 2
            new = np.append(True, (x[1:] != x[:-1]) | (of[1:] != of[:-1]))
            runs = np.append(np.flatnonzero(new), len(of))
            run = np.cumsum(new)[half] - 1
            low, high = runs[run], runs[run + 1]
            below, beyond = low > first, high < first + size
            at = np.where(below & (~beyond | (half - low <= high - half)), low,
                          np.where(beyond, high, half))
            count = sum(map(len, child))
            for a, b in zip(node.tolist(), range(count, count + 2 * len(node), 2)):
                leaf.append((-1, b, a))
            child.append(np.full(2 * len(node), -1))
            boxes.append(self._boxes(z[:, row], np.stack([first, at], 1).ravel()))
            middle = start + at - first
            start, end = np.stack([start, middle], 1).ravel(), np.stack([middle, end], 1).ravel()
            node = np.arange(count, count + len(start))
        self.child = np.concatenate(child)
        for a, b, number in leaf:
            if a < 0:
                self.child[number] = b
        found = sorted(r for r in leaf if r[0] >= 0)
        self.leaf = np.full(len(self.child), -1)
        self.leaf[[r[2] for r in found]] = np.arange(len(found))
        self.low, self.high = np.concatenate(boxes, axis=2)
        start, end = np.array([r[0] for r in found]), np.array([r[1] for r in found])
        place = start[:, None] + np.arange(LEAF)
        inside = place < end[:, None]
        # Places that are not taken have the number -1.
        self.donor = np.where(inside, some[order[np.minimum(place, n - 1)]] if n else -1, -1)
        self.y = y if y.shape[1] else np.full((len(y), 1), np.nan)

    @staticmethod
    def _boxes(z: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Lowest and highest places of stretches of rows; what nobody has lies beyond everything."""
        found = np.full((2, len(z), len(first)), np.nan)
        if z.shape[1]:
            for j in range(len(z)):
                found[:, j] = np.fmin.reduceat(z[j], first), np.fmax.reduceat(z[j], first)
        found[0][np.isnan(found[0])] = np.inf
        found[1][np.isnan(found[1])] = -np.inf
        return found

    def _apart(self, q: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances of questions to boxes."""
        off = np.zeros(len(row))
        for j, i in enumerate(self.axes):
            x = q[i][row]
            # A question that lacks the coordinate is nowhere outside.
            outside = np.fmax(np.fmax(self.low[j][node] - x, x - self.high[j][node]), 0.0)
            off += np.square(outside / self.deviations[i]) if i < self.numbers else outside > 0
        return off

    def own(self, q: np.ndarray) -> np.ndarray:
        """A leaf near every question."""
        node = np.zeros(q.shape[1], np.int64)
        while (row := np.flatnonzero(self.child[node] >= 0)).size:
            first = self.child[node[row]]
            node[row] = first + (self._apart(q, row, first + 1) < self._apart(q, row, first))
        return self.leaf[node]

    def near(self, q: np.ndarray, limit: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, leaf) up to the squared distance `limit`, the nearest `most` if there are more."""
        limit = _slack(limit)
        row, node, done = np.arange(q.shape[1]), np.zeros(q.shape[1], np.int64), []
        off = np.zeros(q.shape[1])
        while True:
            inner = self.child[node] >= 0
            done.append((row[~inner], node[~inner], off[~inner]))
            if not inner.any():
                break
            row, node = np.repeat(row[inner], 2), np.repeat(self.child[node[inner]], 2)
            node[1::2] += 1
            row, node, off = _first(row, node, self._apart(q, row, node), limit, most)
        row, node, _ = _first(*[np.concatenate(x) for x in zip(*done)], limit, most)
        return row, self.leaf[node]

    def distances(self, q: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Squared distances of questions to the donors of leaves; NaN where one lacks a coordinate that
        the question has."""
        donor = self.donor[leaf]
        apart = np.where(donor < 0, np.nan, 0.0)
        for i in self.axes:
            x, y = q[i][row][:, None], self.y[i][donor]
            off = np.square((x - y) / self.deviations[i]) if i < self.numbers else (x != y) + 0.0 * y
            lacks = np.isnan(x[:, 0])
            if lacks.any():
                off[lacks] = 0.0
            apart += off
        return apart

    def bound(self, q: np.ndarray, targets: Sequence[int], k: int) -> np.ndarray:
        """Squared distances within which every question has k donors for each of its holes, by its own
        leaf, or by the leaves around it if that holds too few."""
        limit = np.full(q.shape[1], np.inf)
        for wide in (1, min(AROUND, len(self.donor))):
            left = np.flatnonzero(np.isinf(limit))
            step = max(1, AT_ONCE // LEAF // wide)
            for start in range(0, len(left), step):
                some = left[start:start + step]
                part = q[:, some]
                row = np.repeat(np.arange(len(some)), wide)
                leaf = np.minimum(self.own(part) // wide * wide, len(self.donor) - wide)
                leaf = np.repeat(leaf, wide) + np.tile(np.arange(wide), len(some))
                apart = self.distances(part, row, leaf)
                apart[np.isnan(apart)] = np.inf
                donor = self.donor[leaf]
                most = np.zeros(len(some))
                for target in targets:
                    hole = np.isnan(part[target])
                    known = np.where(np.isnan(self.y[target][donor]), np.inf, apart).reshape(len(some), -1)
                    last = (np.partition(known, k - 1, axis=1)[:, k - 1] if known.shape[1] >= k
                            else np.full(len(some), np.inf))
                    most = np.where(hole, np.maximum(most, last), most)
                limit[some] = most
        return limit

    def nearest(self, q: np.ndarray, targets: Sequence[int], k: int, limit: np.ndarray,
                most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(target, question, donor, squared distance): the k nearest donors of each hole up to `limit`,
        the lower donor first where equally near, out of `most` leaves of a question."""
        limit = np.minimum(limit, self.bound(q, targets, k))
        step, start = max(1, 2 * AT_ONCE // max(8 * LEAF, most.max(initial=0))), 0
        while start < q.shape[1]:
            part = slice(start, start + step)
            row, leaf = self.near(q[:, part], limit[part], most[part])
            order = np.argsort(row, kind="stable")
            row, leaf = row[order], leaf[order]
            for a, b in _runs(row, max(1, AT_ONCE // LEAF)):
                yield from self._best(q, targets, k, limit, row[a:b] + start, leaf[a:b])
            start += step

    def within(self, q: np.ndarray, targets: Sequence[int], k: int, most: int) -> np.ndarray:
        """Squared distances within which every question has k donors for each of its holes, the lowest
        that `most` leaves give."""
        count, limit = np.zeros((len(self.y), q.shape[1]), np.int64), np.zeros(q.shape[1])
        for target, question, _, distance in self.nearest(q, targets, k, np.full(q.shape[1], np.inf),
                                                          np.full(q.shape[1], most)):
            np.add.at(count[target], question, 1)
            np.maximum.at(limit, question, distance)
        for target in targets:
            limit[np.isnan(q[target]) & (count[target] < k)] = np.inf
        return limit

    def _best(self, q: np.ndarray, targets: Sequence[int], k: int, limit: np.ndarray, row: np.ndarray,
              leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        apart = self.distances(q, row, leaf)
        entry, place = np.nonzero(apart <= _slack(limit[row])[:, None])
        question, donor, apart = row[entry], self.donor[leaf[entry], place], apart[entry, place]
        for target in targets:
            open_ = np.isnan(q[target][question]) & ~np.isnan(self.y[target][donor])
            a, b, c = question[open_], donor[open_], apart[open_]
            order = np.lexsort((b, c, a))
            a, b, c = a[order], b[order], c[order]
            best = _rank(a) < k
            if best.any():
                yield target, a[best], b[best], c[best]


def _runs(row: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `size` entries that end where a row ends."""
    start = 0
    while start < len(row):
        end = len(row)
        if start + size < len(row):
            end = int(np.searchsorted(row, row[start + size - 1], side="right"))
        yield start, end
        start = end


@dataclass
class NeighbourModel:
    """What was learned from the training rows."""

    coordinates: Coordinates
    donors: DataFrame
    n_donors: int
    k: int
    tables: int
    bucket: int
    large_bucket: int
    seed: int
    cells: Cells | None = None
    sample: np.ndarray | None = None
    weights: np.ndarray | None = None


# ---- learning -----------------------------------------------------------------------------------

def fit_neighbours(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                   k: int = NEIGHBOURS, tables: int = TABLES, bucket: int | None = None,
                   large_bucket: int | None = None, seed: int = SEED) -> NeighbourModel:
    """Donors, scales and cells out of the training rows. Questions visit up to `tables` cells; a cell
    has `bucket` donors on average and is cut further if it has more than `large_bucket`.

    Infinite numbers, NaN and text that is no number count as missing. Columns of one value have
    the deviation 1. A row without any value is no donor.
    """
    if k < 1 or not [*numeric, *categorical]:
        raise M.PreparationError("neighbours need a column and a positive number")
    if len([*numeric, *categorical]) > 62:
        raise M.PreparationError("neighbours take 62 columns at most")
    ship_package(train.sparkSession)
    c = Coordinates(list(numeric), list(categorical), [], [], [])
    names = [f"y{i}" for i in range(len(c.columns))]
    # Equal rows are counted once; means, deviations and most frequent values follow from the counts.
    rows = train.select(*[v.alias(n) for n, v in zip(names, c.of(train))]).where(
        F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()).groupBy(*names).agg(
        F.count("*").alias("copies"))
    kinds = {f.name: f.dataType for f in rows.schema}
    donors = materialize(rows.withColumn("donor", F.xxhash64(*[
        exact_text(F.col(n), kinds[n]) for n in names])), "neighbours-donors")
    numbers, words = names[:len(numeric)], names[len(numeric):]
    of = [F.when(F.col(n).isNotNull(), F.col("copies")) for n in numbers]
    facts = donors.agg(F.count("*").alias("n"), *[
        F.struct(F.min(n), F.max(n), F.try_divide(F.sum(F.col(n) * F.col("copies")), F.sum(some)))
        for n, some in zip(numbers, of)]).first()
    # The mean of equal values is that value, without a rounding.
    averages = [low if low == high else mean for low, high, mean in facts[1:]]
    c.means = [m or 0.0 for m in averages]
    if numbers:
        spread = donors.agg(*[F.sqrt(F.try_divide(
            F.sum(F.pow(F.col(n) - F.lit(m), 2.0) * F.col("copies")), F.sum(some)))
            for n, m, some in zip(numbers, c.means, of)]).first()
        c.deviations = [d or 1.0 for d in spread]
    modes = {}
    if words:
        # One row per column.
        modes = {r["column"]: r["value"] for r in vocabulary(_word_counts(donors, words), 1).collect()}
    c.fills = [*averages, *[modes.get(n) for n in words]]
    n = facts["n"]
    bucket = bucket or min(BUCKETS[1], max(BUCKETS[0], math.ceil(n / TABLES)))
    model = NeighbourModel(c, donors, n, k, tables, bucket, large_bucket or LARGE * bucket, seed)
    _set_cells(model)
    return model


def _word_counts(donors: DataFrame, words: Sequence[str]) -> DataFrame:
    """(column, value, count) of the words of all training rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in words])
    return donors.select(F.explode(pairs).alias("pair"), "copies").select("pair.*", "copies").where(
        "value IS NOT NULL").groupBy("column", "value").agg(F.sum("copies").alias("n"))


def _coded(c: Coordinates, listed: list[list[str]], batch: pa.RecordBatch | pa.Table,
           prefix: str) -> np.ndarray:
    """Coordinates of rows, an axis per line: numbers and the places of words, NaN where missing."""
    y = np.empty((len(c.columns), batch.num_rows))
    for i in range(len(c.columns)):
        column = batch.column(f"{prefix}{i}")
        if i >= len(c.numeric):
            words = listed[i - len(c.numeric)]
            found = pc.fill_null(pc.index_in(column, value_set=pa.array(words, pa.string())), len(words))
            column = pc.if_else(column.is_valid(), found, None).cast(pa.float64())
        y[i] = _numbers(column)
    return y


def _places(c: Coordinates, listed: list[list[str]], batch: pa.RecordBatch | pa.Table,
            prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows on all axes, and which coordinates they have; a missing one lies at 0."""
    y = _coded(c, listed, batch, prefix)
    for i, (mean, deviation) in enumerate(zip(c.means, c.deviations)):
        y[i] = (y[i] - mean) / deviation
    has = ~np.isnan(y)
    return np.where(has, y, 0.0).T, has.T


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for null."""
    return (column.to_numpy() if isinstance(column, pa.ChunkedArray)
            else column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _sample(model: NeighbourModel, donors: DataFrame, n: int) -> pa.Table:
    """At most about SAMPLE donors, the same ones whenever asked."""
    every = max(1, math.ceil(n / SAMPLE))
    return donors.where(F.pmod(F.xxhash64("donor", F.lit(model.seed)), F.lit(every)) == 0).select(
        "donor", *[f"y{i}" for i in range(len(model.coordinates.columns))]).orderBy("donor").toArrow()


def _set_cells(model: NeighbourModel) -> None:
    """The tree, out of a sample of donors; what is too large after counting is cut further."""
    c, size = model.coordinates, len(model.coordinates.columns)
    numbers = len(c.numeric)
    sample = _sample(model, model.donors, model.n_donors)
    listed = []
    for i in range(numbers, size):
        counts = pc.value_counts(sample.column(f"y{i}").drop_null()).to_pylist()
        counts.sort(key=lambda r: (-r["counts"], r["values"]))
        listed.append([r["values"] for r in counts[:LISTED]])
    axis, cut, child = [-1], [0.0], [-1]
    low, high = [np.full(size, -np.inf)], [np.full(size, np.inf)]

    def tree() -> Cells:
        return Cells(listed, np.array(axis), np.array(cut), np.array(child),
                     np.array(low).reshape(-1, size), np.array(high).reshape(-1, size))

    def grow(node: int, z: np.ndarray, most: float) -> None:
        waiting = [(node, z)]
        while waiting:
            node, z = waiting.pop()
            if len(z) <= max(most, 1):
                continue
            # How far two rows are apart on average, squared.
            wide = [weights[i] * (2 * z[:, i].var() if i < numbers else
                                  1 - np.square(np.bincount(z[:, i].astype(int)) / len(z)).sum())
                    for i in range(size)]
            i = int(np.argmax(wide))
            x = z[:, i]
            if x.min() == x.max():
                continue
            at = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
            at = at if at < x.max() else x[x < at].max()
            if i < numbers:
                # Halfway to the next place, so that a box is not next to those who lie on its edge.
                beyond = x[x > at].min()
                at = at + (beyond - at) / 2 if at + (beyond - at) / 2 < beyond else at
            axis[node], cut[node], child[node] = i, float(at), len(axis)
            for beyond in (False, True):
                axis.append(-1)
                cut.append(0.0)
                child.append(-1)
                low.append(low[node].copy())
                high.append(high[node].copy())
                if beyond:
                    low[-1][i] = at if i < numbers else at + 1
                else:
                    high[-1][i] = at
                waiting.append((len(axis) - 1, z[(x > at) == beyond]))

    z, has = _places(c, listed, sample, "y")
    # Who lacks a coordinate visits both sides of its cuts: what rows with holes often lack is cut late.
    lacking = (~has).sum(axis=0) / max(1, (~has.all(axis=1)).sum())
    model.weights = weights = np.square(1 - 0.99 * lacking)
    y = _coded(c, listed, sample, "y")
    # Rare words are no places of their own: two of them may differ.
    for i, words in enumerate(listed):
        y[numbers + i][y[numbers + i] == len(words)] = -1.0
    # Wide tables keep fewer rows of it for the tasks.
    model.sample = y[:, :max(1, SAMPLE * WIDE // max(WIDE, size))].copy()
    most = model.bucket * len(z) / max(model.n_donors, 1)
    grow(0, z, most)
    for _ in range(ROUNDS if len(z) < model.n_donors and most < SURE else 0):
        cells = tree()
        placed = _placed(replace(model, cells=cells), model.donors, "y")
        # One row per cell that is too large.
        large = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().where(
            F.col("count") > model.large_bucket).collect()}
        if not large:
            break
        inside = placed.where(F.col("cell").isin(list(large)))
        sample = _sample(model, inside, sum(large.values()))
        z, _ = _places(c, listed, sample, "y")
        own = cells.of(z)
        grown = len(axis)
        for node, n in large.items():
            some = z[own == node]
            grow(node, some, model.bucket * len(some) / n)
        if len(axis) == grown:
            break
    model.cells = tree()


# ---- asking -------------------------------------------------------------------------------------

def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _placed(model: NeighbourModel, df: DataFrame, prefix: str) -> DataFrame:
    """`df` and the cell of every row."""
    c, cells, names = model.coordinates, model.cells, df.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, _ = _places(c, cells.listed, batch, prefix)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells.of(z).astype(np.int32))], [*names, "cell"])

    return df.mapInArrow(place, _ddl(df, names) + ", cell int")


def _meet(model: NeighbourModel, donors: DataFrame, visits: DataFrame) -> DataFrame:
    """Donors and questions of a cell together, the donors first and in their order."""
    size = range(len(model.coordinates.columns))
    both = donors.select("cell", "donor", F.lit(None).cast("binary").alias("question"),
                         F.lit(None).cast("long").alias("pattern"),
                         F.lit(None).cast("double").alias("limit"),
                         F.lit(None).cast("int").alias("most"), *[f"y{i}" for i in size]).unionAll(
        visits.select("cell", F.lit(None).cast("long"), "question", "pattern", "limit", "most",
                      *[f"q{i}" for i in size]))
    tasks = max(1, math.ceil(model.n_donors / DONORS_A_TASK))
    tasks = max(tasks, min(both.sparkSession.sparkContext.defaultParallelism, len(model.cells.axis)))
    return both.repartition(tasks, "cell").sortWithinPartitions(
        "cell", F.col("donor").asc_nulls_last())


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(donors, questions) of one cell; the questions in batches, each with the same table of donors."""
    cell, donors = None, []
    for batch in batches:
        at = batch.column("cell").to_numpy()
        ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1 if len(at) else []
        start = 0
        for end in ends:
            if at[start] != cell:
                cell, donors = at[start], []
            some = batch.slice(start, end - start)
            asked = some.column("donor").null_count
            if asked < some.num_rows:
                donors.append(some.slice(0, some.num_rows - asked))
            if asked and donors:
                if isinstance(donors, list):
                    donors = pa.Table.from_batches(donors).combine_chunks()
                yield donors, pa.Table.from_batches([some.slice(some.num_rows - asked)])
            start = end


class _Trees:
    """The leaves of some donors: for each frequent pattern, and for the others."""

    def __init__(self, c: Coordinates, y: np.ndarray, weights: np.ndarray, frequent: Sequence[int]):
        self.c, self.y, self.weights, self.frequent = c, y, weights, set(frequent)
        self.there = ~np.isnan(y)
        self.known: dict[int | None, tuple[Leaves, list[int]]] = {}

    def of(self, pattern: int | None) -> tuple[Leaves, list[int]]:
        """Leaves, and the columns that may be asked."""
        if pattern not in self.known:
            # A donor has what the questions have, and one of their holes.
            size = range(len(self.y))
            own = [i for i in size if pattern is None or pattern >> i & 1]
            holes = [i for i in size if pattern is None or not pattern >> i & 1]
            fit = np.arange(self.y.shape[1])
            if pattern is not None:
                fit = np.flatnonzero(self.there[own].all(axis=0) & self.there[holes].any(axis=0))
            self.known[pattern] = Leaves(self.y, self.c.deviations, own, fit,
                                         self.weights if pattern is None else None), holes
        return self.known[pattern]

    def parts(self, patterns: np.ndarray) -> Iterator[tuple[np.ndarray, Leaves, list[int]]]:
        """Which questions are asked of which leaves."""
        left = np.ones(len(patterns), bool)
        for pattern in np.unique(patterns):
            if int(pattern) in self.frequent:
                left &= patterns != pattern
                yield np.flatnonzero(patterns == pattern), *self.of(int(pattern))
        if left.any():
            yield np.flatnonzero(left), *self.of(None)


def _both(c: Coordinates, donors: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    """Coordinates of donors, words as numbers, and the words in the order of their numbers."""
    y, words = np.empty((len(c.columns), donors.num_rows)), []
    for i in range(len(c.columns)):
        column = donors.column(f"y{i}")
        if i >= len(c.numeric):
            found = column.combine_chunks().dictionary_encode()
            words.append(found.dictionary)
            column = found.indices.cast(pa.float64())
        y[i] = _numbers(column)
    return y, words


def _asked(c: Coordinates, words: list[pa.Array], asked: pa.Table) -> np.ndarray:
    """Coordinates of questions, with the numbers that words of donors have; -1 for other words."""
    q = np.empty((len(c.columns), asked.num_rows))
    for i in range(len(c.columns)):
        column = asked.column(f"y{i}")
        if i >= len(c.numeric):
            found = pc.fill_null(pc.index_in(column, value_set=words[i - len(c.numeric)]), -1)
            column = pc.if_else(column.is_valid(), found, None).cast(pa.float64())
        q[i] = _numbers(column)
    return q


def _visits(model: NeighbourModel, questions: DataFrame, most: int, frequent: Sequence[int]) -> DataFrame:
    """Every cell that a question visits, with the squared distance within which the sample has enough
    donors for it, and the leaves that it may look into there."""
    c, cells, k = model.coordinates, model.cells, model.k
    names = [f"q{i}" for i in range(len(c.columns))]
    # A worker keeps the leaves that it has made of the sample.
    sample = questions.sparkSession.sparkContext.broadcast(
        _Trees(c, model.sample, model.weights, frequent))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sample.value
        for batch in batches:
            q = _coded(c, cells.listed, batch, "q")
            limit = np.full(batch.num_rows, np.inf)
            for some, leaves, holes in trees.parts(batch.column("pattern").to_numpy()):
                limit[some] = leaves.within(q[:, some], holes, k, SAMPLED // LEAF)
            z, has = _places(c, cells.listed, batch, "q")
            for start in range(0, len(z), 1_000):
                some = slice(start, start + 1_000)
                row, cell = cells.near(z[some], has[some], limit[some], most)
                table = pa.Table.from_batches([batch.slice(start, 1_000)]).take(pa.array(row))
                share = np.maximum(1, COMPARED // LEAF // (_rank(row) + 1))
                yield from pa.Table.from_arrays(
                    [pa.array(cell.astype(np.int32)), table.column("question"), table.column("pattern"),
                     pa.array(limit[some][row]), pa.array(share.astype(np.int32)),
                     *[table.column(n) for n in names]],
                    ["cell", "question", "pattern", "limit", "most", *names]).to_batches()

    return questions.select("question", "pattern", *names).mapInArrow(
        plan, "cell int, question binary, pattern long, limit double, most int, " + _ddl(questions, names))


def nearest_donors(model: NeighbourModel, holes: DataFrame, most: int) -> DataFrame:
    """(question, target, donor, distance, number, word): at most k donors for each hole of a question
    out of each of the cells that it visits, `most` at most."""
    c, k, numbers, weights = model.coordinates, model.k, len(model.coordinates.numeric), model.weights
    asked = holes.where("pattern > 0")
    # One row per frequent pattern.
    counts = asked.groupBy("pattern").count()
    frequent = [r["pattern"] for r in counts.crossJoin(F.broadcast(counts.agg(
        F.sum("count").alias("all")))).where(F.col("count") * FREQUENT_SHARE >= F.col("all")).orderBy(
        F.desc("count"), "pattern").limit(FREQUENT).collect()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees, words = None, None, []
        for donors, asked in _by_cell(batches):
            if donors is not held:
                held = donors
                y, words = _both(c, donors)
                trees = _Trees(c, y, weights, frequent)
            q = _asked(c, words, asked)
            limit, most_ = asked.column("limit").to_numpy(), asked.column("most").to_numpy()
            for some, leaves, targets in trees.parts(asked.column("pattern").to_numpy()):
                for target, question, donor, distance in leaves.nearest(
                        q[:, some], targets, k, limit[some], most_[some]):
                    donor = pa.array(donor)
                    value = donors.column(f"y{target}").take(donor)
                    n = len(donor)
                    number, word = pa.nulls(n, pa.float64()), pa.nulls(n, pa.string())
                    yield from pa.Table.from_arrays(
                        [asked.column("question").take(pa.array(some[question])),
                         pa.array(np.full(n, target, np.int32)),
                         donors.column("donor").take(donor), pa.array(distance),
                         *([value, word] if target < numbers else [number, value])],
                        ["question", "target", "donor", "distance", "number", "word"]).to_batches()

    met = _meet(model, _placed(model, model.donors, "y"), _visits(model, asked, most, frequent))
    return met.mapInArrow(search, "question binary, target int, donor long, distance double, "
                                  "number double, word string")


def holes_of(df: DataFrame, model: NeighbourModel) -> DataFrame:
    """(question, pattern, q...): the different rows with a hole, and which columns they have."""
    values = [v.alias(f"q{i}") for i, v in enumerate(model.coordinates.of(df))]
    names = [f"q{i}" for i in range(len(values))]
    rows = df.select(*values).where(
        F.greatest(*[F.col(n).isNull().cast("int") for n in names], F.lit(0)) > 0).distinct()
    pattern = sum((F.when(F.col(n).isNotNull(), F.lit(1 << i).cast("long")).otherwise(0)
                   for i, n in enumerate(names)), F.lit(0).cast("long"))
    return rows.select(_question(rows, names).alias("question"), pattern.alias("pattern"), *names)


def _question(df: DataFrame, names: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[exact_text(F.col(n), df.schema[n].dataType)
                                    for n in names]).cast("binary"))


def _learned(model: NeighbourModel, holes: DataFrame,
             merged: Callable[[NeighbourModel, DataFrame], DataFrame]) -> DataFrame:
    """What `merged` makes of the donors that a question found in its cells; questions with fewer than k
    for one of their holes, which it counts, ask again in more cells."""
    left, found = holes.withColumn("question", F.unhex("question")), None
    size = len(model.coordinates.columns)
    for more in MORE:
        got = materialize(merged(model, nearest_donors(model, left, model.tables * more)),
                          "neighbours-found")
        # Those that ask again are found anew.
        found = got if found is None else found.join(
            left.select("question"), "question", "left_anti").unionByName(got)
        if (model.cells.axis < 0).sum() <= model.tables * more:
            break
        met = got.select("question", *[f"n{i}" for i in range(size)])
        enough = F.forall(F.array(*[_in_pattern(i) | (F.col(f"n{i}") >= model.k)
                                    for i in range(size)]), lambda x: x)
        left = materialize(left.join(met, "question", "left").where(~F.coalesce(
            enough, F.lit(False)) & (F.col("pattern") > 0)).select(*left.columns), "neighbours-left")
        if left.isEmpty():
            break
    return found.drop(*[f"n{i}" for i in range(size)])


def _listed(model: NeighbourModel, near: DataFrame) -> DataFrame:
    """The k nearest donors for all holes of a question, and their counts."""
    order = Window.partitionBy("question", "target").orderBy("distance", "donor")
    counts = [F.count(F.when(F.col("target") == i, 1)).alias(f"n{i}")
              for i in range(len(model.coordinates.columns))]
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= model.k).groupBy(
        "question").agg(*counts, F.collect_list(F.struct(
            "target", "donor", "distance", "number", "word")).alias("near"))


def _filled(model: NeighbourModel, near: DataFrame) -> DataFrame:
    """What the k nearest donors fill the holes of a question with, and their counts."""
    k, numbers, size = model.k, len(model.coordinates.numeric), len(model.coordinates.columns)
    names = ["question", *[f"n{i}" for i in range(size)], *[f"fill{i}" for i in range(size)]]

    def fills(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        of, asked = np.cumsum(new) - 1, int(new.sum())
        target = table.column("target").to_numpy()
        hole = of * size + target
        kept = _rank(hole) < k
        counts = np.bincount(hole[kept], minlength=asked * size).reshape(asked, size)
        found = []
        for i in range(size):
            mine = kept & (target == i)
            if i < numbers:
                total = np.bincount(of[mine], _numbers(table.column("number").filter(pa.array(mine))), asked)
                found.append(pa.array(total / np.maximum(counts[:, i], 1), mask=counts[:, i] == 0))
                continue
            words = table.column("word").filter(pa.array(mine)).combine_chunks().dictionary_encode()
            known = sorted(words.dictionary.to_pylist())
            code = pc.index_in(words.dictionary, value_set=pa.array(known, pa.string())).to_numpy(
                zero_copy_only=False).astype(np.int64)[words.indices.to_numpy(zero_copy_only=False)]
            pair, often = np.unique(of[mine] * max(1, len(known)) + code, return_counts=True)
            row, code = pair // max(1, len(known)), pair % max(1, len(known))
            order = np.lexsort((code, -often, row))
            first = order[_rank(row[order]) == 0]
            best = np.full(asked, -1)
            best[row[first]] = code[first]
            found.append(pa.array(known, pa.string()).take(pa.array(best, mask=best < 0)))
        yield from pa.Table.from_arrays(
            [table.column("question").filter(pa.array(new)), *[pa.array(n) for n in counts.T], *found],
            names).to_batches()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            new = _changes(table)
            # The last question may go on in the next batch.
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            rest = table.slice(last)
            if last:
                yield from fills(table.slice(0, last), new[:last])
        if rest is not None and rest.num_rows:
            yield from fills(rest, _changes(rest))

    return near.repartition("question").sortWithinPartitions(
        "question", "target", "distance", "donor").select(
        "question", "target", "number", "word").mapInArrow(
        fill, "question binary, " + ", ".join(f"n{i} long" for i in range(size)) + ", " + ", ".join(
            f"fill{i} {'double' if i < numbers else 'string'}" for i in range(size)))


def _changes(table: pa.Table) -> np.ndarray:
    """Which rows begin a question."""
    question = table.column("question").combine_chunks()
    new = np.ones(len(question), bool)
    new[1:] = pc.not_equal(question[1:], question[:-1]).to_numpy(zero_copy_only=False)
    return new


def neighbours(model: NeighbourModel, holes: DataFrame) -> DataFrame:
    """(question, target, donor, distance, number, word): the k nearest donors for all holes."""
    return _learned(model, holes, _listed).select(
        F.lower(F.hex("question")).alias("question"), F.inline("near"))


def _in_pattern(i: int) -> Column:
    return F.getbit("pattern", F.lit(i)) == 1


def impute(df: DataFrame, model: NeighbourModel) -> DataFrame:
    """`df` with the model's columns filled: numbers as doubles, categories as trimmed text.

    A number becomes the mean of its k nearest donors' values, a category their most frequent one,
    the lowest of equally frequent ones. Where no donor shares a coordinate, the mean or most
    frequent value of the training rows is taken, and null where there is none. Rows without a
    hole keep their values; copies are filled alike.
    """
    c = model.coordinates
    holes = materialize(holes_of(df, model), "neighbours-holes")
    kinds = ["double"] * len(c.numeric) + ["string"] * len(c.categorical)
    learned = _learned(model, holes, _filled).withColumnRenamed("question", "_question")
    names = [f"q{i}" for i in range(len(c.columns))]
    rows = df.withColumns({f"_{n}": v for n, v in zip(names, c.of(df))})
    holed = F.greatest(*[F.col(f"_{n}").isNull().cast("int") for n in names], F.lit(0)) > 0
    filled = {col: F.coalesce(F.col(f"_q{i}"), F.col(f"fill{i}"), F.lit(c.fills[i]).cast(kinds[i]))
              for i, col in enumerate(c.columns)}
    # Only rows with a hole are looked up; the others stay where they are.
    whole = rows.where(~holed).withColumns(
        {f"fill{i}": F.lit(None).cast(kind) for i, kind in enumerate(kinds)})
    asking = rows.where(holed).withColumn("_key", F.unhex(_question(rows, [f"_{n}" for n in names])))
    joined = asking.join(learned, F.col("_key") == F.col("_question"), "left")
    return joined.drop("_question", "_key").unionByName(whole).select(
        *[filled[n].alias(n) if n in filled else quoted(n) for n in df.columns])
