"""Ranked lexical search without random access: posting lists are read from their best end on.

The documents are dealt into shards. A shard holds, for every term asked for, the documents with
that term in order of falling impact. An item is answered by reading its lists a step at a time,
all of them side by side. What has been read of a document is its lower score; the upper score adds,
for every list in which it has not turned up yet, the impact at which that list now stands. A
document whose upper score is below the tenth best lower score is out. Reading goes on until lower
and upper score of all others are equal: then members, ties and scores are settled.

Shards are read on their own, so nothing but ten rows per item and task is shuffled; a task carries
the scores reached in its earlier shards on as the score to beat. Items come in blocks of bounded
size, each one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import doc_columns
from furrow.session import materialize, ship_package

BEST = 10
# Terms of the items that are searched for in one pass.
BLOCK_TERMS = 200_000
# Documents and postings of a shard; a document of more postings is a shard of its own.
SHARD_DOCUMENTS, SHARD_POSTINGS = 32_768, 4_000_000
# How many entries of each list the first step reads; every further step reads twice as many.
FIRST_STEP = 256
# What a byte becomes: letters in lower case, digits and bytes of other characters stay.
_TERM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
                    else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order; only A to Z are lower-cased."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Item:
    """One item of a block: its id and the terms it asks for, each with how often."""

    item_id: object
    wanted: dict[bytes, int]


def item_blocks(items: DataFrame, id_col: str, text_col: str,
                most: int) -> Iterator[list[Item]]:
    """Items with a term, some at a time; equal rows are one item."""
    block, size = [], 0
    for row in doc_columns(items, id_col, text_col).distinct().toLocalIterator():
        wanted = dict(Counter(terms(row["text"].encode("utf-8", "surrogatepass"))))
        if not wanted:
            continue
        if block and size + len(wanted) > most:
            yield block
            block, size = [], 0
        block.append(Item(row["doc_id"], wanted))
        size += len(wanted)
    if block:
        yield block


# ---- the index ----------------------------------------------------------------------------------

def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) per document: its terms in all, and how often it has those of
    the vocabulary, by their numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                some = batch.slice(start, 1_000)
                sizes, ends, found, times = [], [0], [], []
                for text in some.column("text").cast(pa.binary()):
                    words = terms(text.as_py())
                    sizes.append(len(words))
                    own = Counter(map(number, words))
                    own.pop(None, None)
                    found.extend(own.keys())
                    times.extend(own.values())
                    ends.append(len(found))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                    ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(
        count, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


# ---- reading lists ------------------------------------------------------------------------------

class Shard:
    """Posting lists of some documents, each in order of falling impact."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.documents = documents
        used, first = np.unique(term, return_index=True)
        self.lists = dict(zip(used.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)])))
        self.read = 0

    def best(self, wanted: list[tuple[int, int, int]], best: int,
             to_beat: int) -> list[tuple[int, int]]:
        """The `best` documents of highest score, of equal ones the first, with exact scores.

        `wanted` holds number, weight and times of each term. Documents below `to_beat` are left
        out, as are those without a score.
        """
        lists = [(*self.lists[t], w * times) for t, w, times in wanted
                 if w > 0 and t in self.lists]
        lower = np.zeros(self.documents, np.int64)
        # What the lists in which a document has turned up stand at.
        passed = np.zeros(self.documents, np.int64)
        at, stand = [first for first, _, _ in lists], [0] * len(lists)
        for k, (first, _, factor) in enumerate(lists):
            stand[k] = int(self.impact[first]) * factor
        step = FIRST_STEP
        while True:
            for k, (first, end, factor) in enumerate(lists):
                if at[k] == end:
                    continue
                upto = min(end, at[k] + step)
                new = self.doc[at[k]:upto]
                lower[new] += self.impact[at[k]:upto] * factor
                now = int(self.impact[upto - 1]) * factor if upto < end else 0
                passed[self.doc[first:at[k]]] += now - stand[k]
                passed[new] += now
                self.read += upto - at[k]
                at[k], stand[k] = upto, now
            step *= 2
            if self.documents > best:
                to_beat = max(to_beat, int(np.partition(lower, -best)[-best]))
            upper = lower + (sum(stand) - passed)
            alive = np.flatnonzero(upper >= max(to_beat, 1))
            if (upper[alive] == lower[alive]).all():
                break
        order = alive[np.argsort(-lower[alive], kind="stable")][:best]
        return [(int(d), int(lower[d])) for d in order]


def _shards(batches: Iterator[pa.RecordBatch], documents: int,
            postings: int) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut to shards."""
    held, rows, size = [], 0, 0
    for batch in batches:
        lengths = batch.column("terms").value_lengths().to_numpy()
        start = 0
        while start < batch.num_rows:
            room = np.cumsum(lengths[start:start + documents - rows])
            take = int(np.searchsorted(room, postings - size, "right"))
            if take == 0 and rows == 0:
                take = 1
            if take:
                held.append(batch.slice(start, take))
                rows, size, start = rows + take, size + int(room[take - 1]), start + take
            if start < batch.num_rows or rows == documents:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best_of_block(index: DataFrame, block: list[Item], weights: dict[int, int],
                   vocabulary: dict[bytes, int], documents: int, total: int, best: int,
                   item_kind: str, shard_documents: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents per item, items by their number."""
    kind = index.schema["doc_id"].dataType.simpleString()
    asked = [[(vocabulary[t], weights.get(vocabulary[t], 0), times)
              for t, times in item.wanted.items()] for item in block]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = [[] for _ in asked]
        for batch in _shards(batches, shard_documents, shard_postings):
            # In the order of ids, so that of equal scores the lower ids come first.
            batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_end"))
            column = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            counts = batch.column("counts").flatten().to_numpy()
            # 75 * n * N needs more than 64 bits on very large tables.
            damp = np.array([25 + 75 * n * documents // total
                             for n in batch.column("n").to_pylist()], dtype=np.int64)
            impact = 1_000_000_000 * counts // (1000 * counts + 8 * damp[doc])
            shard = Shard(doc, column.flatten().to_numpy(), impact, batch.num_rows)
            rows = []
            for k, wanted in enumerate(asked):
                to_beat = reached[k][-1] if len(reached[k]) == best else 0
                found = shard.best(wanted, best, to_beat)
                rows.extend((k, d, score) for d, score in found)
                reached[k] = sorted(reached[k] + [s for _, s in found], reverse=True)[:best]
            if rows:
                item, local, score = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int32()), batch.column("doc_id").take(pa.array(local)),
                     pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(answer, f"item int, doc_id {kind}, score long")


def ranked_search(items: DataFrame, docs: DataFrame, item_id: str = "item_id",
                  item_text: str = "text", id_col: str = "doc_id", text_col: str = "text",
                  best: int = BEST, block_terms: int = BLOCK_TERMS,
                  shard_documents: int = SHARD_DOCUMENTS,
                  shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0.

    Scores are those of a saturating term count with length damping, in integers. Equal scores
    rank by ascending id, null ids last; repeated rows of documents rank one after the other.
    Equal rows of items are one item; rows of one id with other texts are ranked each for itself.
    Null and empty texts have no term: such an item has no row, such a document is not counted. Other
    columns are not read; an empty table on either side gives an empty result. Whole texts count.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = doc_columns(docs, id_col, text_col)
    item_type = items.schema[item_id].dataType.simpleString()
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame(
        [], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for block in item_blocks(items, item_id, item_text, block_terms):
        vocabulary: dict[bytes, int] = {}
        for item in block:
            for term in item.wanted:
                vocabulary.setdefault(term, len(vocabulary))
        index = materialize(term_counts(texts, vocabulary), "search-index")
        documents, total = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not documents:
            return found
        # One row per term of the block.
        holding = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = {r["term"]: term_weight(documents, r["count"]) for r in holding}
        ranked = _best_of_block(index, block, weights, vocabulary, documents, total, best,
                                item_type, shard_documents, shard_postings)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame([(k, item.item_id) for k, item in enumerate(block)],
                                      f"item int, item_id {item_type}")
        found = found.unionByName(top.join(names, "item").select(
            "item_id", "rank", "doc_id", "score"))
    return found
