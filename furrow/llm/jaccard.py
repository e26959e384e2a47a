"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Texts with equal n-gram sets are one class; only classes are compared. Bands of a class's MinHash
signature are shuffled by their hash. In a bucket every class is tied to the smallest one, so a
bucket of n gives n - 1 edges, and any two classes of one bucket are in one component of these
edges. Inside a component all pairs of classes are compared on their full sets, in blocks whose size
is bounded: a block pair counts the n-grams that its classes share by a matrix product. It returns
link counts per class and a spanning forest of the links, not the links themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD, apart, doc_columns, full_text, named, unused_name
from furrow.llm.components import components
from furrow.session import materialize, ship_package

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 256
# Classes and n-grams of one block, and columns of one product.
BLOCK_CLASSES, BLOCK_NGRAMS, COLUMNS = 512, 250_000, 4_096
REMEMBERED = 300_000
_WORDS = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL,
                 most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose recall at the threshold is `recall`."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


class _Words(dict):
    """Word hashes, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(text: str, n: int = NGRAM) -> np.ndarray:
    """The sorted set of a text's n-grams as 64-bit hashes.

    A text of fewer words has one n-gram, all of them; one without a word has none.
    """
    hashes = np.array([_words[w] for w in _WORDS.findall(text)], dtype=np.uint64)
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    h = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        h = _mixed(h * _ODD + hashes[k:k + count])
    return np.unique(h)


@lru_cache(maxsize=4)
def _family(size: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_229)
    return (draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            draw.integers(0, 1 << 63, size, dtype=np.uint64))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the MinHash signature."""
    factor, shift = _family(bands * rows)
    lowest = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(grams), 1024):
        some = grams[start:start + 1024]
        np.minimum(lowest, (factor[:, None] * some + shift[:, None]).min(axis=1), out=lowest)
    h = np.arange(bands, dtype=np.uint64)
    for part in lowest.reshape(bands, rows).T:
        h = _mixed(h * _ODD + part)
    return h.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Of (doc_id, mark, text): key of the n-gram set (null without one), its size, bands."""
    schema = pa.schema([("key", pa.binary()), ("n_grams", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                some = batch.slice(start, 1_000)
                found = []
                for text in some.column("text"):
                    grams = ngrams(text.as_py(), n)
                    found.append((None, 0, None) if not len(grams) else (
                        xxhash.xxh3_128_digest(grams.tobytes()), len(grams),
                        band_hashes(grams, bands, rows)))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("mark"),
                     *(pa.array(c, t) for c, t in zip(zip(*found), schema.types))],
                    ["doc_id", "mark", *schema.names])

    return docs.mapInArrow(
        sign, f"doc_id {kind}, mark long, key binary, n_grams long, bands array<long>")


# ---- blocks ---------------------------------------------------------------------------------

def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set on the left shares with each on the right."""
    def flat(sets):
        return (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))

    (a, row_a), (b, row_b) = flat(left), flat(right)
    common = np.intersect1d(a, b)
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    place_a, place_b = np.searchsorted(common, a), np.searchsorted(common, b)
    place_a[place_a == len(common)] = 0
    place_b[place_b == len(common)] = 0
    if not len(common):
        return counts
    in_a, in_b = common[place_a] == a, common[place_b] == b
    place_a, row_a, place_b, row_b = place_a[in_a], row_a[in_a], place_b[in_b], row_b[in_b]
    order_a, order_b = np.argsort(place_a, kind="stable"), np.argsort(place_b, kind="stable")
    place_a, row_a = place_a[order_a], row_a[order_a]
    place_b, row_b = place_b[order_b], row_b[order_b]
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        product = []
        for place, row, size in ((place_a, row_a, len(left)), (place_b, row_b, len(right))):
            first, last = np.searchsorted(place, [start, start + width])
            dense = np.zeros((size, width), dtype=np.float32)
            dense[row[first:last], place[first:last] - start] = 1
            product.append(dense)
        counts += product[0] @ product[1].T
    return counts


def _forest(size: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of these pairs."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for x, y in pairs.tolist():
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[ry] = rx
            chosen.append((x, y))
    return chosen


def compared(group: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Links between the classes of one block pair: counts per class, and a forest."""
    group = group.drop_duplicates("key").reset_index(drop=True)
    sets = [ngrams(text, n) for text in group["text"]]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    weight = group["size"].to_numpy()
    mine = group["block"].to_numpy()
    low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
    rows, columns = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
    counts = shared_counts([sets[k] for k in rows], [sets[k] for k in columns]) if (
        len(rows) and len(columns)) else np.zeros((len(rows), len(columns)))
    union = sizes[rows][:, None] + sizes[columns][None, :] - counts
    linked = counts >= threshold * union - 1e-6
    if low == high:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(group), dtype=np.int64)
    links[rows] += (linked * weight[columns][None, :]).sum(axis=1)
    if low != high:
        links[columns] += (linked * weight[rows][:, None]).sum(axis=0)
    x, y = np.nonzero(np.triu(linked) if low == high else linked)
    edges = _forest(len(group), np.stack([rows[x], columns[y]], axis=1))
    key = group["key"]
    found = [(key[k], None, int(links[k])) for k in np.flatnonzero(links)]
    found += [(key[p], key[q], 0) for p, q in edges]
    return pd.DataFrame(found, columns=["a", "b", "links"])


# ---- the join -------------------------------------------------------------------------------

def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL,
                  most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row per row of `docs`: doc_id, mark, class_id, n_links, n_grams, kept.

    n_links counts the other rows whose n-gram set has a Jaccard similarity of `threshold` or
    more with this row's, rows with an equal set included. class_id is the smallest id that chains
    of links lead to; `kept` is true for the rows of that id and its smallest text mark (a 64-bit
    hash of the text). A text without a word, null included, has no link and is its own class; a
    text of fewer words than `n` is one n-gram. Null ids come last; repeated rows link to each
    other; other columns are not read, and an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall, most_hashes)
    texts = doc_columns(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")).select(
        "doc_id", "mark", "text")
    signed = materialize(signatures(texts, n, bands, rows), "jaccard-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = materialize(signed.where("key IS NOT NULL").groupBy("key").agg(
        F.min(order).alias("first"), F.count("*").alias("size"),
        F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")),
        "jaccard-classes")

    banded = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    hubs = banded.groupBy("band", "hash").agg(
        F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = banded.join(hubs, ["band", "hash"]).where("key != hub").select(
        F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    parts = components(near, "jaccard-candidates")

    links = _verified(texts, classes, parts, n, threshold)
    chained = components(links.where("b IS NOT NULL").select("a", "b"), "jaccard-links")
    counted = links.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    rooted = classes.select("key", "first", "size").join(
        chained, F.col("key") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "key"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    by_class = rooted.join(heads, "root").join(
        counted, F.col("key") == F.col("a"), "left").select(
        "key", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    alone = F.col("head").isNull()
    return signed.join(by_class, "key", "left").select(
        "doc_id", "mark",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_grams",
        (alone | (F.col("head.doc_id").eqNullSafe(F.col("doc_id"))
                  & (F.col("head.mark") == F.col("mark")))).alias("kept"))


def _verified(texts: DataFrame, classes: DataFrame, parts: DataFrame, n: int,
              threshold: float) -> DataFrame:
    """(a, null, links) per linked class and block pair, (a, b, 0) for forests of links."""
    roots = parts.select(F.col("root").alias("node"), "root").distinct()
    members = classes.select("key", "first", "size", "n_grams").join(
        parts.unionByName(roots), F.col("key") == F.col("node"))
    # A component gets as many blocks as its n-grams and classes need.
    blocks = members.groupBy("root").agg(F.ceil(F.greatest(
        F.sum("n_grams") / BLOCK_NGRAMS, F.count("*") / BLOCK_CLASSES)).cast("int").alias(
        "blocks"))
    chosen = members.join(blocks, "root").select(
        "root", "key", "size", "blocks", F.col("first.doc_id").alias("first_id"),
        F.col("first.mark").alias("first_mark"),
        F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    listed = texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["first_id"]) & (
        texts["mark"] == chosen["first_mark"])).select(
        "root", "key", "size", "block", "text",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = listed.select("root", "key", "size", "block", "text",
                          F.least("block", "other").alias("low"),
                          F.greatest("block", "other").alias("high"))
    return materialize(dealt.groupBy("root", "low", "high").applyInPandas(
        lambda group: compared(group, n, threshold), "a binary, b binary, links long"),
        "jaccard-verified")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **settings) -> DataFrame:
    """The rows of `docs`, one of each class of linked texts, with all their columns.

    The row of the smallest id stays; of repeated rows one does.
    """
    gone = jaccard_links(docs, id_col, text_col, **settings).groupBy("doc_id", "mark").agg(
        F.first("kept").alias("kept"), F.count("*").alias("n"),
        F.max("n_grams").alias("n_grams")).where("NOT kept OR (n > 1 AND n_grams > 0)")
    number, key, mark, kept = (unused_name(docs, c) for c in ("number", "of", "mark", "kept"))
    gone = materialize(gone.select(F.col("doc_id").alias(key), F.col("mark").alias(mark),
                                   F.col("kept").alias(kept)), "jaccard-gone")
    listed, others = apart(docs, F.xxhash64(named(id_col), F.xxhash64(full_text(text_col))),
                           gone, F.xxhash64(key, mark))
    rows = listed.join(gone.hint("merge"), named(id_col).eqNullSafe(F.col(key)) & (
        F.xxhash64(full_text(text_col)) == F.col(mark)), "left")
    untouched = others.unionAll(rows.where(F.col(kept).isNull()).select(*others.columns))
    from pyspark.sql import Window
    repeated = rows.where(kept).withColumn(number, F.row_number().over(
        Window.partitionBy(key, mark).orderBy(mark))).where(F.col(number) == 1)
    columns = [named(c) for c in docs.columns]
    return untouched.select(*columns).unionAll(repeated.select(*columns))
