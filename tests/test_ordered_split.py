"""Splits by time and by group, against sorting in Python."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from furrow import model as M
from furrow.operators import ordered_split as O
from furrow.operators import split as S


def of_test(split):
    return split.rows.where(F.col(S.SPLIT) == S.TEST)


@pytest.mark.parametrize("buckets", [2, 3, 4096])
def test_value_at_any_rank(spark, buckets):
    values = [-2**63, 2**63 - 1, 0, 0, 0, 5, -7, 10**15]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for rank, value in enumerate(sorted(values), 1):
        if buckets == 4096 or rank in (1, 4, 8):
            assert O.value_at(df, rank, buckets) == (
                value, sum(v < value for v in values), values.count(value))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int"])
def test_split_time_with_ties(spark, kind):
    draw = random.Random(5)
    days = [draw.randrange(40) for _ in range(301)]
    first = datetime.datetime(1969, 12, 20)
    cells = [d if kind == "int" else first + datetime.timedelta(days=d, microseconds=(
        0 if kind == "date" else d % 3)) for d in days]
    if kind == "date":
        cells = [c.date() for c in cells]
    df = spark.createDataFrame(list(enumerate(cells)), f"id long, at {kind}").repartition(4)
    split = O.split_time(df, "at", 0.3, 42, ["id"])
    test = {r.id for r in of_test(split).collect()}
    assert len(test) == split.n_test == 91 and split.rows.count() == 301
    order = sorted(range(301), key=lambda i: days[i], reverse=True)
    edge = days[order[90]]
    assert {i for i in range(301) if days[i] > edge} <= test
    assert all(days[i] >= edge for i in test)
    again = O.split_time(df.repartition(7), "at", 0.3, 42, ["id"])
    assert {r.id for r in of_test(again).collect()} == test


def test_split_time_of_copies_and_edges(spark):
    copies = spark.createDataFrame([(1, "x")] * 10, "at int, name string")
    split = O.split_time(copies, "at", 0.25)
    assert of_test(split).count() == 3 and split.part(S.TRAIN).count() == 7
    empty = O.split_time(copies.where("false"), "at", 0.25)
    assert empty.rows.count() == 0 and empty.rows.columns == ["at", "name", S.SPLIT]
    holed = spark.createDataFrame([(1,), (None,)], "at int")
    for wrong in ((holed, "at", 0.2), (copies, "name", 0.2), (copies, "at", 1.0)):
        with pytest.raises(M.PreparationError):
            O.split_time(*wrong)


@pytest.mark.parametrize("ranked", [O.RANKED_GROUPS, 3])
def test_groups_stay_whole(spark, ranked):
    draw = random.Random(6)
    # One group holds a third of all rows.
    groups = [None if k % 50 == 0 else 7 if k % 3 == 0 else draw.randrange(200) for k in range(900)]
    df = spark.createDataFrame(list(enumerate(groups)), "id long, who int").repartition(5)
    split = O.split_group(df, "who", 0.2, 3, ranked)
    rows = split.rows.withColumn("token", O.group_token(df, ["who"], 3)).collect()
    assert len({(r.who, r.split) for r in rows}) == len(set(groups)) == split.groups
    assert sum(r.split == S.TEST for r in rows) == split.n_test
    sizes = collections.Counter(r.token for r in rows)
    ends, upto = [], 0
    for token in sorted(sizes)[:-1]:
        upto += sizes[token]
        ends.append(upto)
    assert split.n_test == min(ends, key=lambda e: abs(e - split.wanted))


def test_seeds_and_sides(spark):
    df = spark.createDataFrame([(k, "ab"[k == 0]) for k in range(20)], "id long, who string")
    found = {O.split_group(df, "who", share, seed).n_test for share in (0.01, 0.99) for seed in range(3)}
    assert found <= {1, 19}
    with pytest.raises(M.PreparationError, match="two groups"):
        O.split_group(df.where("id > 0"), ["who"], 0.2)
    with pytest.raises(M.PreparationError):
        O.split_group(df, "who", 0.0)
    # Values that join to the same text are different groups.
    pairs = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert O.split_group(pairs, ["x", "y"], 0.5).n_test == 1
