"""BPE encoding and decoding with a tokenizer file, long texts by tree concatenation.

A text of up to LEAF characters is encoded where it lies. A longer one is cut into leaves, which
are dealt over the tasks and encoded on their own; neighbouring encodings are then joined pairwise
up a tree. Around each join a window is encoded anew and grows until it shares a token with the
left encoding before the join and one with the right encoding behind it. A token sequence is the
BPE encoding of its text exactly if every two neighbours are, so the spliced sequence is the
encoding of the joined text: each pair of neighbours stands in one of the three.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import doc_columns
from furrow.llm.memory import Memory
from furrow.session import ship_package

LEAF = 65_536
# Characters on either side of a join that the first window takes; longer than any added token.
WINDOW = 128
# Bytes that a worker remembers of words, and characters of texts whose words it learns at once.
REMEMBERED = 128 << 20
LEARNT = 1 << 20
_WORD = re.compile(r"[^ \t\n\r]+")


@dataclass
class Encoding:
    """Token ids of a piece of text and where each token starts and ends in it."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def shifted(self, by: int) -> Encoding:
        return Encoding(self.ids, self.starts + by, self.ends + by)

    def part(self, first: int, last: int) -> Encoding:
        return Encoding(self.ids[first:last], self.starts[first:last], self.ends[first:last])


def _concat(*parts: Encoding) -> Encoding:
    return Encoding(*(np.concatenate([getattr(p, k) for p in parts])
                      for k in ("ids", "starts", "ends")))


class Coder:
    """The tokenizer of one worker, with a bounded memory for words.

    Tokens never span a blank, so a text is the sequence of its words' encodings.
    """

    _of: dict[str, Coder] = {}

    def __init__(self, path: str):
        # Spark has a task for every core; threads of the library would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(REMEMBERED)

    @classmethod
    def at(cls, path: str) -> Coder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, text: str) -> Encoding:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        return Encoding(np.array(found.ids, dtype=np.int32), spans[:, 0], spans[:, 1])

    def decode(self, ids) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def learn(self, words: Iterable[str]) -> None:
        """Remember token count, ids and decoded text of those that are new."""
        new = self.memory.missing(words)
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(
                some, add_special_tokens=False)]
            decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            listed = [" ".join(map(str, i)) for i in ids]
            self.memory.put(some, zip(map(len, ids), listed, decoded),
                            sum(map(len, listed)) + sum(map(len, decoded)))

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str, str]]:
        """Per text: token count, SHA-256 of its ids and of the decoded text, its ids as text.

        Decoding puts one space between tokens, so it goes word by word as well.
        """
        def told() -> Iterator[tuple[int, str, str, str]]:
            self.learn(itertools.chain.from_iterable(waiting))
            for words in waiting:
                found = [x for x in map(self.memory.now.__getitem__, words) if x[0]]
                ids = " ".join([x[1] for x in found])
                yield (sum(x[0] for x in found), sha256(ids),
                       sha256(" ".join([x[2] for x in found])), ids)
            waiting.clear()

        waiting, size = [], 0
        for text in texts:
            waiting.append(_WORD.findall(text))
            size += len(text)
            if size > LEARNT:
                yield from told()
                size = 0
        yield from told()


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# ---- joining --------------------------------------------------------------------------------

def _clean_tokens(e: Encoding) -> np.ndarray:
    """Tokens whose both ends lie between characters: bytes of one character share its span."""
    before = np.concatenate([[True], e.starts[1:] >= e.ends[:-1]])
    behind = np.concatenate([e.ends[:-1] <= e.starts[1:], [True]])
    return before & behind


def _shared(one: Encoding, other: Encoding, low: int, high: int) -> tuple[int, int] | None:
    """Indices of a token that both have, inside [low, high], at neither's very end."""
    def keys(e: Encoding) -> dict[tuple[int, int, int], int]:
        first, last = np.searchsorted(e.starts, [low, high])
        clean = _clean_tokens(e)
        return {(int(e.ids[k]), int(e.starts[k]), int(e.ends[k])): int(k)
                for k in range(first, min(last, len(e.ids)))
                if clean[k] and e.ends[k] <= high and 0 < k < len(e.ids) - 1}

    mine, theirs = keys(one), keys(other)
    both = mine.keys() & theirs.keys()
    if not both:
        return None
    key = min(both, key=lambda k: k[1])
    return mine[key], theirs[key]


def joined(coder: Coder, text: str, left: Encoding, right: Encoding, cut: int) -> Encoding:
    """The encoding of `text` from those of text[:cut] and text[cut:], the latter shifted."""
    if not len(left.ids) or not len(right.ids):
        return coder.encode(text)
    reach = WINDOW
    while reach < len(text):
        # The window starts and ends where tokens do.
        first = max(0, int(np.searchsorted(left.starts, cut - reach, "right")) - 1)
        last = int(np.searchsorted(right.starts, cut + reach))
        start = int(left.starts[first])
        end = int(right.ends[last]) if last < len(right.ids) else len(text)
        window = coder.encode(text[start:end]).shifted(start)
        on_left = _shared(left, window, start, cut)
        on_right = _shared(window, right, cut, end)
        if on_left and on_right and on_left[1] < on_right[0]:
            return _concat(left.part(0, on_left[0]), window.part(on_left[1], on_right[0]),
                           right.part(on_right[1], len(right.ids)))
        reach *= 2
    return coder.encode(text)


def tree(coder: Coder, leaves: list[str], encodings: list[Encoding]) -> Encoding:
    """Neighbours joined pairwise until one encoding of the whole text is left."""
    nodes = list(zip(leaves, encodings))
    while len(nodes) > 1:
        pairs = []
        for k in range(0, len(nodes) - 1, 2):
            (a, left), (b, right) = nodes[k], nodes[k + 1]
            pairs.append((a + b, joined(coder, a + b, left, right.shifted(len(a)), len(a))))
        nodes = pairs + nodes[len(pairs) * 2:]
    return nodes[0][1]


# ---- as Spark operators ---------------------------------------------------------------------

def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False,
                     leaf: int = LEAF) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    Added tokens' strings inside a text count as those tokens; none is added. Null counts as the
    empty text, which has no token. Repeated rows give repeated results, other columns are not
    read, and an empty table gives an empty result. No text is shortened: one longer than `leaf`
    characters is cut, its leaves encoded by whichever tasks get them, and joined again.
    """
    ship_package(docs.sparkSession)
    rows = doc_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if with_ids else "")

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.at(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                counts, ids, decoded, listed = map(list, zip(*coder.digests(
                    text.as_py() for text in some.column("text"))))
                columns = [some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids),
                           pa.array(decoded)]
                if with_ids:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(
                        ends, np.fromstring(" ".join(listed), np.int32, sep=" ")))
                yield pa.RecordBatch.from_arrays(columns, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                for number, start in enumerate(range(0, len(text), leaf)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(k, 1), batch.column("key").slice(k, 1),
                         batch.column("copies").slice(k, 1), pa.array([number], pa.int32()),
                         pa.array([text[start:start + leaf]])],
                        ["doc_id", "key", "copies", "leaf", "text"])

    def encode_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.at(path)
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                e = coder.encode(text)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(k, 1).columns,
                     *(pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
                       for x in (e.ids, e.starts, e.ends))],
                    ["doc_id", "key", "copies", "leaf", "text", "ids", "starts", "ends"])

    def join_leaves(group: pd.DataFrame) -> pd.DataFrame:
        coder = Coder.at(path)
        leaves = group.sort_values("leaf")
        found = tree(coder, leaves["text"].tolist(), [
            Encoding(np.asarray(i, np.int32), np.asarray(s, np.int64), np.asarray(e, np.int64))
            for i, s, e in zip(leaves["ids"], leaves["starts"], leaves["ends"])])
        ids = found.ids.tolist()
        row = {"doc_id": group["doc_id"].iloc[0], "n_tokens": len(ids),
               "ids_sha256": sha256(" ".join(map(str, ids))),
               "decoded_sha256": sha256(coder.decode(ids)), "copies": group["copies"].iloc[0]}
        return pd.DataFrame([row | ({"ids": ids} if with_ids else {})])

    long_text = F.length("text") > leaf
    short = rows.where(~long_text).mapInArrow(whole, result)
    leaf_schema = f"doc_id {kind}, key string, copies long, leaf int, text string"
    # Rows that repeat id and text are counted before the shuffle and written out at the end.
    once = rows.where(long_text).groupBy("doc_id", F.sha2("text", 256).alias("key")).agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    # With a number, Spark does not put the few long texts' leaves back into one task.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = once.mapInArrow(cut, leaf_schema).repartition(tasks, "key", "leaf")
    encoded = dealt.mapInArrow(
        encode_leaf, leaf_schema + ", ids array<int>, starts array<int>, ends array<int>")
    joined_texts = encoded.groupBy("doc_id", "key").applyInPandas(
        join_leaves, result + ", copies long")
    repeated = joined_texts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return short.unionByName(repeated.drop("copies", "copy"))
