"""Which columns say the same: equal columns, and mutual information of all pairs.

Equal columns are found by signatures: sums over rows of a digest of the row and the column's value,
the same for two columns if they agree in every row, whatever the order of rows. One aggregate gives
all of them; columns with equal signatures are then compared value by value in a second pass.

Mutual information comes from contingency tables that hold only the pairs of values that occur.
Columns become narrow numbers once. Pairs of columns with few values are counted inside every task, and
the tasks' counts are added up. For any other pair the rows are dealt out by the column with more
values, packed into a few 64-bit numbers, so that a task counts this column against many others at
once and hands on two numbers per pair: a row is shuffled once per such column, not once per pair.
Values too frequent for one task are counted by pairs of values instead.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.text import exact_text, finite_double, quoted
from furrow.session import materialize, ship_package, small_table

BINS = 10
# Column pairs that one pass counts.
PAIRS_A_PASS = 48
# Different values that a column may have to be numbered by a list of them.
LISTED = 16_384
# Cells of a table that tasks count whole, if there are so many rows per cell or the cells are few.
CELLS, ROWS_PER_CELL, FEW_CELLS = 1 << 18, 16, 4_096
# Rows of a task that counts one column against others; more frequent values are counted apart.
ROWS_A_TASK = 200_000
# Rows that are counted into cells together, and columns per aggregate query.
ROWS_AT_ONCE, COLUMNS_PER_PASS = 1 << 17, 24
SUMS = "a int, b int, rows long, s double"


# ---- equal columns ------------------------------------------------------------------------------

def column_signatures(df: DataFrame) -> DataFrame:
    """(ordinal, column, signature, other_signature): two 64-bit sums per column, one row each."""
    texts = {f.name: exact_text(quoted(f.name), f.dataType) for f in df.schema}
    row = F.xxhash64(*texts.values())
    sums = []
    for k, text in enumerate(texts.values()):
        for j, salt in enumerate((0, 1)):
            digest = F.xxhash64(F.lit(salt), F.col("_row"), text)
            # Decimals, as the sum of many digests exceeds 64 bits.
            sums.append(F.sum(digest.cast("decimal(38,0)")).alias(f"_{k}_{j}"))
    found = df.withColumn("_row", row).agg(*sums)
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("column"),
                 F.coalesce(F.col(f"_{k}_0"), F.lit(0)).cast("string").alias("signature"),
                 F.coalesce(F.col(f"_{k}_1"), F.lit(0)).cast("string").alias("other_signature"))
        for k, name in enumerate(texts)])))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(column, duplicate_of): columns that equal an earlier one in every row, nulls being equal.

    Values of different types are equal if their exact texts are. An empty table has none.
    """
    groups: dict[tuple, list[str]] = {}
    # One row per column.
    for r in column_signatures(df).orderBy("ordinal").collect():
        groups.setdefault((r["signature"], r["other_signature"]), []).append(r["column"])
    pairs = [(first, c) for first, *more in groups.values() for c in more]
    spark = df.sparkSession
    if not pairs:
        return spark.range(0).select(F.lit("").alias("column"), F.lit("").alias("duplicate_of"))
    kinds = {f.name: f.dataType for f in df.schema}

    def text(name: str) -> Column:
        return exact_text(quoted(name), kinds[name])

    differing = df.agg(F.count("*").alias("_rows"), *[
        F.count(F.when(~text(a).eqNullSafe(text(b)), 1)).alias(f"_{k}")
        for k, (a, b) in enumerate(pairs)])
    checked = F.array(*[F.struct(F.lit(b).alias("column"), F.lit(a).alias("duplicate_of"),
                                 F.col(f"_{k}").alias("differing"), F.col("_rows").alias("rows"))
                        for k, (a, b) in enumerate(pairs)])
    return differing.select(F.inline(checked)).where("differing = 0 AND rows > 0").select(
        "column", "duplicate_of")


# ---- mutual information -------------------------------------------------------------------------

@dataclass
class Coded:
    """Columns c0, c1, ... of numbers below 2 ** width, or of any 64 bits; no two of them are equal.

    `places` tells which of them stands for each of the asked columns, `values` about how many
    different numbers each has.
    """

    codes: DataFrame
    rows: int
    places: list[int]
    widths: list[int]
    values: list[int]


def _facts(df: DataFrame, wanted: dict[str, Column]) -> dict[str, object]:
    """Named aggregates over all rows, some columns' at a time."""
    found: dict[str, object] = {}
    for start in range(0, len(wanted), 2 * COLUMNS_PER_PASS):
        some = list(wanted.items())[start:start + 2 * COLUMNS_PER_PASS]
        found.update(df.agg(*[c.alias(name) for name, c in some]).head().asDict())
    return found


def _codes(df: DataFrame, columns: Sequence[str], binned: Sequence[str], bins: int) -> Coded:
    """Every column as numbers: its bin, the distance to the lowest integer, the place among the
    digests of its values if these are few, or else the digest."""
    kinds = {f.name: f.dataType for f in df.schema}
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    raw = {i: finite_double(quoted(c), kinds[c]) if c in binned else
           quoted(c).cast("long") if isinstance(kinds[c], whole) else None
           for i, c in enumerate(columns)}
    digests = {i: F.xxhash64(exact_text(quoted(c), kinds[c])) for i, c in enumerate(columns)}
    wanted = {"rows": F.count("*")}
    for i, c in enumerate(columns):
        if raw[i] is not None:
            wanted |= {f"low{i}": F.min(raw[i]), f"high{i}": F.max(raw[i])}
        if c not in binned:
            wanted[f"values{i}"] = F.approx_count_distinct(digests[i])
    facts = _facts(df, wanted)
    cells, widths, values, listed = [], [], [], []
    for i, c in enumerate(columns):
        low, high, many = facts.get(f"low{i}"), facts.get(f"high{i}"), facts.get(f"values{i}", 0)
        if c in binned:
            if low is None or high == low:
                code = F.when(raw[i].isNotNull(), F.lit(0))
            else:
                code = F.least(F.floor((raw[i] - low) / (high - low) * bins), F.lit(bins - 1))
            code, top, many = F.coalesce(code.cast("long"), F.lit(-1)) + 1, bins, bins + 1
        elif low is not None and high - low < (LISTED * 4 if many <= LISTED else 1 << 62):
            code, top = F.coalesce(raw[i] - F.lit(low) + 1, F.lit(0)), high - low + 1
        else:
            code, top = digests[i], None
            if many <= LISTED:
                listed.append(i)
        cells.append(code.cast("long").alias(f"c{i}"))
        widths.append(64 if top is None else max(1, top.bit_length()))
        values.append(max(many, 1))
    codes = df.select(*cells)
    if listed:
        # The different values of columns that have few.
        found = codes.select(F.inline(F.array(*[F.struct(
            F.lit(i).alias("i"), F.col(f"c{i}").alias("x")) for i in listed]))).distinct().collect()
        lists = {i: np.sort(np.array([r["x"] for r in found if r["i"] == i], np.int64))
                 for i in listed}
        for i in listed:
            widths[i] = max(1, (len(lists[i]) - 1).bit_length())
        names = codes.columns

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.searchsorted(lists[i], batch.column(i).to_numpy()))
                    if i in lists else batch.column(i) for i in range(len(names))], names)

        codes = codes.mapInArrow(number, ", ".join(f"{n} long" for n in names))
    codes = materialize(codes, "dependence-codes")
    places = _equal_codes(codes, list(zip(widths, values)))
    return Coded(codes, facts["rows"], places, widths, values)


def _equal_codes(codes: DataFrame, alike: list[tuple[int, int]]) -> list[int]:
    """For every column the first one with the same codes; narrow columns are not compared."""
    pairs = [(a, b) for b in range(len(alike)) for a in range(b)
             if alike[a] == alike[b] and alike[b][1] > 1 << 9]
    differing = _facts(codes, {f"{a}_{b}": F.count(F.when(F.col(f"c{a}") != F.col(f"c{b}"), 1))
                               for a, b in pairs})
    places = list(range(len(alike)))
    for a, b in pairs:
        if not differing[f"{a}_{b}"]:
            places[b] = min(places[b], places[a])
    return places


def _passes(pairs: Sequence, most: int) -> Iterator[list]:
    pairs = iter(pairs)
    while some := list(itertools.islice(pairs, most)):
        yield some


def _summed(counted: DataFrame) -> DataFrame:
    """Rows, and the sum of n * ln(n), which is all that entropies need, per pair of columns."""
    return counted.groupBy("a", "b").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.log("n")).alias("s"))


def _counted_whole(coded: Coded, pairs: list[tuple[int, int]]) -> DataFrame:
    """Sums of pairs of columns with few values: every task counts all cells."""
    used = sorted({i for pair in pairs for i in pair})
    widths, at = coded.widths, {i: k for k, i in enumerate(used)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.zeros(1 << widths[a] + widths[b], np.int64) for a, b in pairs]

        def add(some: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(some)
            x = [table.column(k).to_numpy() for k in range(len(used))]
            for n, (a, b) in zip(cells, pairs):
                n += np.bincount(x[at[a]] << widths[b] | x[at[b]], minlength=len(n))

        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(w.num_rows for w in waiting) >= ROWS_AT_ONCE:
                add(waiting)
                waiting = []
        if waiting:
            add(waiting)
        for n, (a, b) in zip(cells, pairs):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), a, np.int32)), pa.array(np.full(len(some), b, np.int32)),
                 pa.array(some.astype(np.int64)), pa.array(n[some])], ["a", "b", "cell", "n"])

    cells = coded.codes.select(*[f"c{i}" for i in used]).mapInArrow(
        count, "a int, b int, cell long, n long")
    return _summed(cells.groupBy("a", "b", "cell").agg(F.sum("n").alias("n")))


def _layout(widths: Sequence[int]) -> list[tuple[int, int]]:
    """(number, shift) of fields of these widths, packed into 64-bit numbers, in their order."""
    found, number, used = [], 0, 0
    for width in widths:
        if used + width > (64 if used == 0 else 63):
            number, used = number + 1, 0
        found.append((number, used))
        used += width
    return found


def _dealt(coded: Coded, rows: DataFrame, owner: int, others: list[int]) -> DataFrame:
    """Sums of `owner` with itself, and with other columns: rows are dealt out by its values."""
    fields = [owner, *(i for i in others if i != owner)]
    widths = [coded.widths[i] for i in fields]
    layout = _layout(widths)
    packed = []
    for number in range(layout[-1][0] + 1):
        whole = F.lit(0).cast("long")
        for i, (at, shift) in zip(fields, layout):
            if at == number:
                whole = whole.bitwiseOR(F.shiftleft(F.col(f"c{i}"), shift))
        packed.append(whole.alias(f"p{number}"))
    masks = [-1 if w == 64 else (1 << w) - 1 for w in widths]
    with_itself = owner in others

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        numbers = [table.column(k).to_numpy() for k in range(table.num_columns)]

        def field(k: int) -> np.ndarray:
            at, shift = layout[k]
            return numbers[at] >> shift & masks[k]

        def numbered(x: np.ndarray) -> tuple[np.ndarray, int]:
            different, x = np.unique(x, return_inverse=True)
            return x, max(1, (len(different) - 1).bit_length())

        x, width = numbered(field(0))
        sums = []
        for k in range(0 if with_itself else 1, len(fields)):
            cell = x
            if k:
                y, w = field(k), widths[k]
                if width + w > 63:
                    y, w = numbered(y)
                cell = x << w | y
            cell = np.sort(cell)
            ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
            n = np.diff(ends, prepend=-1)
            n = n[n > 1]
            sums.append((min(owner, fields[k]), max(owner, fields[k]), len(x),
                         float((n * np.log(n)).sum())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(
                zip(*sums), (pa.int32(), pa.int32(), pa.int64(), pa.float64()))],
            ["a", "b", "rows", "s"])

    key = F.col("p0") if masks[0] == -1 else F.col("p0").bitwiseAND(F.lit(masks[0]))
    tasks = max(1, math.ceil(coded.rows / ROWS_A_TASK))
    return rows.select(*packed).repartition(tasks, key).mapInArrow(count, SUMS).groupBy("a", "b").agg(
        F.sum("rows").alias("rows"), F.sum("s").alias("s"))


def _by_values(rows: DataFrame, owner: int, others: list[int]) -> DataFrame:
    """The same sums for rows of a few frequent values, counted by pairs of values."""
    cells = F.array(*[F.struct(
        F.lit(min(owner, i)).alias("a"), F.lit(max(owner, i)).alias("b"),
        F.col(f"c{owner}").alias("x"), F.col(f"c{i}").alias("y")) for i in others])
    return _summed(rows.select(F.inline(cells)).groupBy("a", "b", "x", "y").agg(
        F.count("*").alias("n")))


def _frequent(coded: Coded, owners: list[int]) -> dict[int, list[int]]:
    """The values of these columns with more rows than one task should count."""
    if not owners or coded.rows <= ROWS_A_TASK:
        return {}
    share = max(ROWS_A_TASK / coded.rows / 2, 5e-4)
    likely = coded.codes.stat.freqItems([f"c{i}" for i in owners], share).head()
    found = {}
    for i in owners:
        name = f"c{i}"
        counts = coded.codes.where(F.col(name).isin(likely[f"{name}_freqItems"])).groupBy(
            name).count().where(F.col("count") > ROWS_A_TASK)
        found[i] = [r[0] for r in counts.collect()] if likely[f"{name}_freqItems"] else []
    return {i: some for i, some in found.items() if some}


def mutual_information(df: DataFrame, columns: Sequence[str] | None = None,
                       binned: Sequence[str] = (), bins: int = BINS,
                       pairs_a_pass: int = PAIRS_A_PASS) -> DataFrame:
    """(a, b, mi, h_a, h_b, normalized) of all pairs of columns, in nats.

    A missing value counts as a value. The columns in `binned` are cut into `bins` equal widths
    between their least and greatest finite number; their other values count as missing.
    `normalized` is mi / sqrt(h_a * h_b), 0 where a column is constant. A column with as many values
    as the table has rows gives a contingency table as long, which is counted as well, in parts.
    """
    spark = df.sparkSession
    ship_package(spark)
    columns = list(columns or df.columns)
    coded = _codes(df, columns, list(binned), bins)
    whole, dealt = [], {}
    different = sorted(set(coded.places))
    for a, b in itertools.combinations_with_replacement(different, 2):
        cells = coded.values[a] * (coded.values[b] if a != b else 1)
        wide = coded.widths[a] + coded.widths[b]
        if 1 << min(wide, 62) <= CELLS and (cells <= FEW_CELLS
                                            or cells * ROWS_PER_CELL <= coded.rows):
            whole.append((a, b))
        else:
            owner = max(a, b, key=lambda i: coded.values[i])
            dealt.setdefault(owner, []).append(a + b - owner)
    parts = [_counted_whole(coded, some) for some in _passes(whole, pairs_a_pass)]
    frequent = _frequent(coded, list(dealt))
    for owner, others in dealt.items():
        rows, apart = coded.codes, None
        if owner in frequent:
            often = F.col(f"c{owner}").isin(frequent[owner])
            rows, apart = rows.where(~often), rows.where(often)
        for some in _passes(others, pairs_a_pass):
            parts.append(_dealt(coded, rows, owner, some))
            if apart is not None:
                parts.append(_by_values(apart, owner, some))
    tables = None
    for part in parts:
        sums = materialize(part, "dependence")
        tables = sums if tables is None else tables.unionAll(sums)
    entropy = tables.groupBy("a", "b").agg(F.sum("rows").alias("rows"), F.sum("s").alias("s")).select(
        "a", "b", (F.log("rows") - F.col("s") / F.col("rows")).alias("h"))
    single = entropy.where("a = b")
    # One row per pair of columns: where its entropies are.
    at = coded.places
    asked = small_table(spark, [
        (a, b, at[a], at[b], min(at[a], at[b]), max(at[a], at[b]))
        for a, b in itertools.combinations(range(len(columns)), 2)],
        "i int, j int, i_at int, j_at int, least int, most int")
    both = asked.join(single.select(F.col("a").alias("i_at"), F.col("h").alias("h_a")), "i_at").join(
        single.select(F.col("a").alias("j_at"), F.col("h").alias("h_b")), "j_at").join(
        entropy.select(F.col("a").alias("least"), F.col("b").alias("most"),
                       F.col("h").alias("h_ab")), ["least", "most"])
    mi = F.greatest(F.col("h_a") + F.col("h_b") - F.col("h_ab"), F.lit(0.0))
    names = F.array(*map(F.lit, columns))
    least = F.lit(1e-12)
    return both.select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), mi.alias("mi"),
        "h_a", "h_b", F.when((F.col("h_a") > least) & (F.col("h_b") > least),
                             mi / F.sqrt(F.col("h_a") * F.col("h_b"))).otherwise(0.0).alias(
            "normalized"))
