"""Splits by time and by group: the latest rows, or whole groups, are the test part.

The time of the cut is found like a median: rows are counted in equal ranges of time, and the one
range that holds the wanted rank is counted again. A step shuffles at most BUCKETS counts and there
are at most six, however the times lie. Rows of the very time of the cut are told apart by a token of
their key. Groups are counted once; the cut through their hashed order is found by adding up their
rows per token prefix, so neither rows nor groups are ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import model as M
from furrow.functions.text import exact_text, keyed_token, quoted, whole_row_token
from furrow.operators import split as S
from furrow.session import materialize

BUCKETS = 4096
# Groups that one task may put in order; more are first narrowed by prefix.
RANKED_GROUPS = 100_000


# ---- by time ------------------------------------------------------------------------------------

def _position(value: Column, dtype: T.DataType) -> Column:
    """The time as a 64-bit number that rises with it."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.TimestampNTZType):
        # Days and time of day, as no zone may move it.
        day = F.unix_date(value.cast("date")).cast("long") * 86_400
        second = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        micros = F.date_format(value, "SSSSSS").cast("long")
        return (day + second) * 1_000_000 + micros
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(dtype, T.IntegralType):
        return value.cast("long")
    raise M.PreparationError("the time column is a date, a timestamp or a whole number")


def value_at(numbers: DataFrame, rank: int, buckets: int = BUCKETS) -> tuple[int, int, int]:
    """The number of this rank (from 1) in a column `x` without nulls, how many lie below it, and how
    many equal it."""
    low, high = numbers.agg(F.min("x"), F.max("x")).head()
    below, inside = 0, numbers
    while True:
        # Exact arithmetic: the range of 64-bit numbers exceeds 64 bits.
        width = -(-(high - low + 1) // buckets)
        if width == 1:
            place = (F.col("x") - F.lit(low)).cast("long")
        else:
            offset = F.col("x").cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")
            place = F.floor(offset / F.lit(str(width)).cast("decimal(20,0)")).cast("long")
        counts = inside.groupBy(place.alias("place")).agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        # At most `buckets` counts.
        for r in sorted(counts.collect(), key=lambda r: r["place"]):
            if below + r["n"] >= rank:
                break
            below += r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low, below, r["n"]
        inside = numbers.where(F.col("x").between(low, high))


def split_time(df: DataFrame, time: str, test_size: float, seed: int = 42,
               key: Sequence[str] | None = None) -> S.Split:
    """The ceil(n * test_size) latest rows are the test part; exact for any times.

    Of the rows of the time at which the cut falls, those of the smallest key tokens are test rows
    (without a key, of the tokens of the whole row); equal rows are divided by number. Rows without a
    time are refused with their count.
    """
    if not 0 < test_size < 1:
        raise M.PreparationError("the test part lies between 0 and 1")
    at = _position(quoted(time), df.schema[time].dataType)
    numbers = df.select(at.alias("x"))
    n, known = numbers.agg(F.count("*"), F.count("x")).head()
    if n != known:
        raise M.PreparationError(f"{n - known} rows without a time in {time}")
    n_test = S.test_rows(n, test_size)
    quotas = df.sparkSession.range(1).select(
        F.lit("all").alias(S.CLASS), F.lit(n).cast("long").alias("rows"),
        F.lit(n_test).cast("long").alias("quota"))
    if not n:
        return S.Split(df.withColumn(S.SPLIT, F.lit(S.TRAIN)), 0, 0, False, quotas)
    cut, below, equal = value_at(numbers, n - n_test + 1)
    tested = n_test - (n - below - equal)
    part = F.when(at >= cut, S.TEST).otherwise(S.TRAIN)
    if tested == equal:
        return S.Split(df.withColumn(S.SPLIT, part), n, n_test, False, quotas)
    clear = df.where(at != cut).withColumn(S.SPLIT, part)
    token = keyed_token([quoted(c) for c in key], seed) if key else whole_row_token(
        df.schema, df.columns)
    tied = df.where(at == cut).withColumn(S.CLASS, F.lit("all")).withColumn(S.TOKEN, token)
    needs = materialize(quotas.select(S.CLASS, F.lit(tested).cast("long").alias("need")), "needs")
    marked = S.mark_rows(tied, needs, equal, df.columns, single=True)
    return S.Split(clear.unionByName(marked), n, n_test, False, quotas)


# ---- by group -----------------------------------------------------------------------------------

@dataclass
class GroupSplit:
    """Rows with a `split` column. `n_test` misses `wanted` by at most half of the largest group,
    unless a single group had to be put on a side that would else be empty."""

    rows: DataFrame
    n: int
    n_test: int
    wanted: int
    groups: int

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col(S.SPLIT) == name).drop(S.SPLIT)


def group_token(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """A token of the group; equal values have equal ones, and rows without a value form a group."""
    texts = [exact_text(quoted(c), df.schema[c].dataType) for c in columns]
    return F.md5(F.concat(F.lit(f"{seed}|group"), *[
        F.concat(F.lit("|"), F.length(t).cast("string"), F.lit(":"), t) for t in texts]
    ).cast("binary"))


def split_group(df: DataFrame, columns: str | Sequence[str], test_size: float, seed: int = 42,
                ranked_groups: int = RANKED_GROUPS) -> GroupSplit:
    """Whole groups to either side: in their hashed order as many as come nearest to the quota.

    The quota is ceil(n * test_size) rows; if the group at the cut leaves both sides equally near, it
    stays in training. Each side gets at least one group, so a table needs two.
    """
    if not 0 < test_size < 1:
        raise M.PreparationError("the test part lies between 0 and 1")
    columns = [columns] if isinstance(columns, str) else list(columns)
    token = group_token(df, columns, seed)
    # Combined inside every task first, so a group of a third of all rows is one count per task.
    sizes = materialize(df.groupBy(token.alias(S.TOKEN)).agg(F.count("*").alias("rows")), "groups")
    n, groups = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).head()
    if groups < 2:
        raise M.PreparationError(f"two groups are needed, found {groups}")
    wanted = S.test_rows(n, test_size)
    last, n_test = _group_cut(sizes, wanted, groups, ranked_groups)
    rows = df.withColumn(S.SPLIT, F.when(token <= last, S.TEST).otherwise(S.TRAIN))
    return GroupSplit(rows, n, n_test, wanted, groups)


def _group_cut(sizes: DataFrame, wanted: int, groups: int, ranked: int) -> tuple[str, int]:
    """The token of the last test group, and the rows up to it."""
    before, prefix, inside = 0, "", sizes
    while groups > ranked and len(prefix) < S.TOKEN_WIDTH:
        width = len(prefix) + S.PREFIX_STEP
        counts = inside.groupBy(F.substring(S.TOKEN, 1, width).alias("prefix")).agg(
            F.sum("rows").alias("rows"), F.count("*").alias("groups"))
        # At most 4,096 counts.
        for r in sorted(counts.collect(), key=lambda r: r["prefix"]):
            if before + r["rows"] >= wanted:
                break
            before += r["rows"]
        prefix, groups = r["prefix"], r["groups"]
        inside = sizes.where(F.col(S.TOKEN).startswith(prefix))
    running = F.sum("rows").over(Window.orderBy(S.TOKEN))
    over = inside.withColumn("upto", running + F.lit(before)).where(
        F.col("upto") >= wanted).orderBy(S.TOKEN).head()
    token, upto, size = over[S.TOKEN], over["upto"], over["rows"]
    # The group before and after the cut, by order of tokens.
    earlier = sizes.where(F.col(S.TOKEN) < token).agg(F.max(S.TOKEN)).head()[0]
    later = sizes.where(F.col(S.TOKEN) > token).agg(F.min(S.TOKEN)).head()[0]
    taken = upto - wanted < wanted - (upto - size)
    if earlier is None or (taken and later is not None):
        return token, upto
    return earlier, upto - size
