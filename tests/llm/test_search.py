"""Ranked search against scores of all documents."""

import collections
import math
import random
import re

import numpy as np
import pytest

from llm_rows import EDGE_ROWS, SCHEMA
from furrow.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(items, docs, best=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    with_terms = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    found = []
    for item, text in set(items):
        scores = []
        for i, c in counts:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * with_terms + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * sum(c.values()) * with_terms // total
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        found += [(str(item), rank, str(s[3]), -s[0])
                  for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:best], 1)]
    return sorted(found)


def run(spark, items, docs, **settings):
    found = search.ranked_search(
        spark.createDataFrame(items, "item_id long, text string"),
        spark.createDataFrame([(*d, 1, "x") for d in docs],
                              "doc_id long, text string, rank int, score string").repartition(3),
        **settings)
    return sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in found.collect())


def test_terms_of_bytes():
    for text in ("A-b_C9 éÉx\x7fq", "İSTANBUL ŠK", "中文，字", "\x00a\x00", ""):
        assert [t.decode() for t in search.terms(text.encode())] == terms(text)


@pytest.mark.parametrize("settings", [{}, {"shard_documents": 7, "block_terms": 5},
                                      {"shard_postings": 3}, {"best": 3}])
def test_against_all_scores(spark, settings):
    draw = random.Random(3)
    pool = [f"w{k}" for k in range(12)] + ["Ünder", "und", "AND"]
    weights = [2 ** -k for k in range(15)]

    def text():
        return " ".join(draw.choices(pool, weights, k=draw.randint(0, 25)))

    docs = [(k, text()) for k in range(160)] + [(None, "w1 w9"), (3, "w1 w1"), (3, "w1 w1"), (8, None)]
    items = [(k, text()) for k in range(12)] + [(40, None), (41, ""), (42, "unheard of")]
    items += [items[0], (1, "w5 w5 w6")]
    want = brute(items, docs, settings.get("best", 10))
    assert len(want) > 30
    assert run(spark, items, docs, **settings) == want


def test_ties_across_shards(spark):
    """Equal scores rank by id, wherever their documents lie."""
    docs = [(k, "same words here") for k in range(60, 0, -1)] + [(0, "other")]
    assert run(spark, [(1, "words")], docs, shard_documents=8) == brute([(1, "words")], docs)


def test_lists_are_read_to_where_scores_are_settled():
    """A document known from its only list settles the item before long lists are read through."""
    size = 20_000
    doc = np.concatenate([np.arange(size), np.arange(30)])
    term = np.concatenate([np.zeros(size, int), np.ones(30, int)])
    impact = np.concatenate([np.full(size, 5), np.arange(1_000_030, 1_000_000, -1)])
    shard = search.Shard(doc, term, impact, size)
    found = shard.best([(1, 2, 1), (0, 0, 1)], 10, 0)
    assert [d for d, _ in found] == list(range(10)) and shard.read == 30
    assert shard.best([(1, 2, 1), (0, 1, 1)], 10, 0)[0] == (0, 2_000_065)


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE_ROWS, SCHEMA)
    items = spark.createDataFrame([(1, "old text some", "z")], "item_id int, text string, rank string")
    rows = search.ranked_search(items, docs).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in rows] == [(1, 1), (2, 2), (3, 2)]
    nothing = spark.createDataFrame([], SCHEMA)
    assert search.ranked_search(items, nothing).count() == 0
    assert search.ranked_search(items.where("false"), docs).count() == 0
