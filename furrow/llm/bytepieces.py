"""Byte-level BPE by a sentencepiece model that is written out of a vocabulary of ranks.

Every byte is mapped to a character of its own and every token to the string of its bytes. These
strings are the pieces of a BPE model with identity normalisation; a piece's score is its negative
rank, so the best merge is the one of lowest rank and, among equals, the leftmost one, as in the
merges the ranks come from. Pre-tokens are encoded by that model one by one; a pre-token that is a
token itself but that merges do not reach is that token. Ids go back to bytes by the inverse of the
mapping, from the model's own pieces.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.common import doc_columns
from furrow.llm.memory import Memory
from furrow.session import ship_package

# Bytes that a worker remembers of pre-tokens, and pre-tokens that it holds of one text.
REMEMBERED = 64 << 20
RUN = 1 << 17
# The character of byte 0; the others follow it.
FIRST = 0x100

# ---- fixed values: field numbers and values of the model file's format ----------------------
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5
VARINT, BYTES, FLOAT = 0, 2, 5
# -------------------------------------------------------------------------------------------

# Between pre-tokens that are mapped together: half a character, which no text holds.
BETWEEN = "\ud800"


def mapped(data: bytes) -> str:
    """One character per byte."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + FIRST).tobytes().decode("utf-16-le")


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


# ---- the model file ---------------------------------------------------------------------------

def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | BYTES) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | FLOAT) + struct.pack("<f", value)
    return _varint(number << 3 | VARINT) + _varint(value)


def model_file(ranks: dict[bytes, int]) -> bytes:
    """A BPE model whose piece number r is the token of rank r; the unknown piece comes last.

    Ranks have to be 0 to n - 1 and hold all single bytes, so that nothing is unknown.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have to be 0, 1, 2 and so on")
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {lacking}")
    if len(tokens) > 1 << 24:
        raise ValueError("scores of more than 2^24 tokens are not exact")
    pieces = [(mapped(t), -float(r), NORMAL) for r, t in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, UNKNOWN))
    return b"".join([
        *(_field(PIECES, _field(PIECE, p.encode()) + _field(SCORE, s) + _field(KIND, k))
          for p, s, k in pieces),
        _field(TRAINER, _field(MODEL_TYPE, BPE)),
        _field(NORMALIZER, _field(NAME, b"identity") + b"".join(
            _field(n, 0) for n in (DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS)))])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens in base64 and their ranks, a pair in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


# ---- the splitter ------------------------------------------------------------------------------

# Classes that a pattern may name.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def _ranges(points: list[int]) -> str:
    """The inside of a character class of these code points."""
    found = []
    for p in points:
        if found and found[-1][1] == p - 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


@lru_cache(maxsize=1)
def class_members() -> dict[str, list[int]]:
    """The code points of each class, as the encoder's own version of Unicode has them."""
    import tiktoken
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    by_byte = {bytes([b]): b for b in range(256)}
    probes = {name: tiktoken.Encoding(name, pat_str=name, mergeable_ranks=by_byte,
                                      special_tokens={}) for name in CLASSES}
    return {name: [ord(c) for c in p.decode(p.encode_ordinary(every))]
            for name, p in probes.items()}


def spelled_out(pattern: str, below: int) -> str:
    """`pattern` with its classes written as ranges of the code points under `below`.

    Python's own matcher does not know the classes, is several times faster with ranges, and
    then agrees with the encoder whatever version of Unicode either follows.
    """
    ranges = {name: _ranges([c for c in members if c < below])
              for name, members in class_members().items()}
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ranges:
            out.append(ranges[part] if inside else f"[{ranges[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{ranges[r'\s']}]")
        elif re.match(r"\\[a-zA-Z]", part) and part not in (r"\n", r"\r", r"\t"):
            raise ValueError(f"the class {part} is not known")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def splitters(pattern: str) -> tuple[str, str]:
    """The pattern for texts without characters above U+FFFF, and that for all texts."""
    return spelled_out(pattern, 0x10000), spelled_out(pattern, 0x110000)


class Pieces:
    """The model of one worker, with a bounded memory for pre-tokens."""

    _of: dict[tuple, Pieces] = {}

    def __init__(self, path: str, patterns: tuple[str, str]):
        from sentencepiece import SentencePieceProcessor
        ranks = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=model_file(ranks))
        self.token = [unmapped(self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.plain, self.full = map(re.compile, patterns)
        self.sizes = np.array([len(t) for t in self.token])
        merged = self.model.encode([mapped(t) for t in self.token], num_threads=1)
        self.unreached = {t: [i] for i, t in enumerate(self.token) if merged[i] != [i]}
        self.memory = Memory(REMEMBERED)

    @classmethod
    def at(cls, path: str, patterns: tuple[str, str]) -> Pieces:
        if (path, patterns) not in cls._of:
            cls._of[path, patterns] = cls(path, patterns)
        return cls._of[path, patterns]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of every pre-token."""
        split = mapped(BETWEEN.encode("utf-8", "surrogatepass"))
        pieces = mapped(BETWEEN.join(words).encode("utf-8", "surrogatepass")).split(split)
        # A call with a list starts threads, which is dear for a few.
        ids = self.model.encode(pieces, num_threads=1) if len(pieces) > 40 else [
            self.model.encode(p) for p in pieces]
        if self.unreached:
            ids = [self.unreached.get(unmapped(p)) or i for p, i in zip(pieces, ids)]
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def learn(self, words: Iterable[str]) -> None:
        """Remember the packed ids and the decoded bytes of those that are new."""
        new = self.memory.missing(words)
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            ids = self.encode(some)
            flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4")
            ends = np.cumsum([0, *map(len, ids)])
            places = np.concatenate([[0], np.cumsum(self.sizes[flat])])[ends].tolist()
            packed, data = flat.tobytes(), self.decode(flat.tolist())
            ends = (ends * 4).tolist()
            self.memory.put(some, [
                (packed[a:b], data[c:d]) for a, b, c, d in
                zip(ends, ends[1:], places, places[1:])], len(packed) + len(data))

    def pattern(self, text: str) -> re.Pattern:
        high = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return self.full if high else self.plain

    def known(self, words: list[str]) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers and decoded bytes of words that are remembered."""
        ids, data = zip(*map(self.memory.now.__getitem__, words)) if words else ((), ())
        return b"".join(ids), b"".join(data)

    def runs(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of a text, RUN pre-tokens at a time."""
        found = self.pattern(text).finditer(text)
        while words := [m.group() for m in itertools.islice(found, RUN)]:
            self.learn(words)
            yield self.known(words)

    def encoded(self, texts: Iterable[str]) -> Iterator[Iterator[tuple[bytes, bytes]]]:
        """Per text its ids and decoded bytes, in one part or, if it is long, in several."""
        def flush() -> Iterator[Iterator[tuple[bytes, bytes]]]:
            self.learn(itertools.chain.from_iterable(waiting))
            for words in waiting:
                yield iter([self.known(words)])
            waiting.clear()

        waiting, size = [], 0
        for text in texts:
            if len(text) > RUN:
                yield from flush()
                yield self.runs(text)
                size = 0
                continue
            waiting.append(self.pattern(text).findall(text))
            size += len(text)
            if size > 8 * RUN:
                yield from flush()
                size = 0
        yield from flush()


def digests(parts: Iterator[tuple[bytes, bytes]], keep: bool) -> tuple:
    """Token count, SHA-256 of the ids and of the decoded bytes, and the ids if they are kept."""
    ids_sha, data_sha, size, kept = hashlib.sha256(), hashlib.sha256(), 0, []
    for ids, data in parts:
        ids_sha.update(ids)
        data_sha.update(data)
        size += len(ids) // 4
        if keep:
            kept.append(ids)
    row = size, ids_sha.hexdigest(), data_sha.hexdigest()
    return (*row, np.frombuffer(b"".join(kept), "<i4")) if keep else row


# ---- as a Spark operator ------------------------------------------------------------------------

def encode_bytes(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    `path` names a vocabulary of ranks that every executor can open, `pattern` what a pre-token
    is. Null counts as the empty text, which has no token; special tokens are ordinary text.
    Repeated rows and null ids give a row each, other columns are not read, and an empty table
    gives an empty result. No row needs another one, so nothing is shuffled; a text of any length
    is read run by run, and with `with_ids` its ids are held once.
    """
    ship_package(docs.sparkSession)
    rows = doc_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    patterns = splitters(pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path, patterns)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                found = [digests(parts, with_ids) for parts in pieces.encoded(
                    text.as_py() for text in some.column("text"))]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                columns.insert(0, some.column("doc_id"))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(
        encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                + (", ids array<int>" if with_ids else ""))


def decode_bytes(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that the `ids` of each row decode to; null ids give null."""
    ship_package(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    patterns = splitters(pattern)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path, patterns)
        for batch in batches:
            data = [None if ids is None else pieces.decode(ids)
                    for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, data binary")
