"""Vector codes against plain integer arithmetic over all entries."""

import hashlib
import random

import numpy as np
import pytest

from furrow.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v long"


def plain(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in Python's integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]

    def cut(v):
        n = len(v) // parts
        return [tuple(v[k * n:(k + 1) * n]) for k in range(parts)]

    books = [list(b) for b in zip(*(cut(v) for _, v, _ in first))]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(x, book) for x, book in zip(cut(v), books)] for _, v, _ in kept]
        for j, book in enumerate(books):
            for e in range(len(book)):
                own = [cut(v)[j] for (_, v, _), f in zip(kept, found) if f[j][1] == e]
                if own:
                    book[e] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [[nearest(x, book) for x, book in zip(cut(v), books)] for _, v, _ in kept]
    text = ",".join(str(c) for book in books for y in book for c in y)
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), err, by_label[label],
                   hashlib.sha256(text.encode()).hexdigest())
                  for (i, _, label), f, err in zip(kept, found, error))


def run(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v],
                                 label, "x", None) for i, v, label in rows], SCHEMA)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256)
                  for r in codes.vector_codes(df.repartition(3)).collect())


def test_ties_negatives_and_few_values(spark):
    draw = random.Random(2)
    rows = [(k, [draw.choice([-1, -0.5, -1 / 256, 0, 1 / 512, 0.3, 1]) for _ in range(32)],
             draw.choice([1, 2, None])) for k in range(300)]
    rows += rows[:40] + [(5, rows[7][1], 1), (None, rows[9][1], None)]
    assert run(spark, rows) == plain(rows)


def test_vectors_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 10, -k / 7] * 8, k % 2) for k in range(5)]
    bad = [(7, None, 1), (8, [nan] + [0.0] * 15, 1), (9, [inf] + [0.0] * 15, None),
           (10, [None] + [0.0] * 15, 1), (11, [-inf] * 16, 0)]
    assert run(spark, good + bad) == plain(good + bad)
    assert run(spark, bad) == [] == run(spark, [])


def test_lengths_and_sizes_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [0.0] * 10, 1)])
    with pytest.raises(Exception, match="16 components"):
        run(spark, [(1, [0.0] * 16, 1)] * 70 + [(99, [0.0] * 32, 1)])
    with pytest.raises(ValueError, match="exceeds"):
        run(spark, [(1, [1e9] * 16, 1)])


@pytest.mark.parametrize("scale", [3, 500, 50_000_000])
def test_bounds_never_lose_the_nearest(scale):
    draw = np.random.default_rng(scale)
    parts = draw.integers(-scale, scale + 1, (4_000, 4))
    entries = draw.integers(-scale, scale + 1, (64, 4))
    pivots = codes.choose_pivots(entries[None], 4)[0]
    found, distance, evaluated = codes.nearest(parts, codes.squared(parts, pivots), entries, pivots)
    exact = codes.squared(parts, entries)
    assert (found == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    # Most comparisons are spared.
    assert scale < 100 or evaluated < 0.25 * exact.size
