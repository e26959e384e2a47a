"""Byte-level BPE by a model written out of ranks, against the library the ranks belong to."""

import hashlib
import os
import random

import pytest
import public_tokenizers
import tiktoken

from llm_rows import EDGE_ROWS, SCHEMA
from furrow.llm import bytepieces
from furrow.llm.memory import Memory
from furrow.llm.queries import QUERIES, vocabulary

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bytepieces.read_ranks(PATH))


@pytest.fixture(scope="module")
def pieces():
    return bytepieces.Pieces.at(PATH, bytepieces.splitters(public_tokenizers.PATTERN))


def ids_of(pieces, text):
    found = bytepieces.digests(next(iter(pieces.encoded([text]))), keep=True)
    return found[3].tolist()


def digest(data):
    return hashlib.sha256(data).hexdigest()


def ids_digest(ids):
    return digest(b"".join(i.to_bytes(4, "little") for i in ids))


def test_pieces_of_mixed_texts(pieces, library):
    draw = random.Random(1)
    pool = ["a", "the", " ", "  ", "\n", "é", "中", "👩", "'s", "'S", "1", "99", "\x85", "\xa0", "\x1c",
            "!!", "՘", "\x00", "ſ", "\t", "<|endoftext|>", "Ā", "▁"]
    for _ in range(3_000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 30)))
        assert ids_of(pieces, text) == library.encode_ordinary(text), text
        parts = list(next(iter(pieces.encoded([text]))))
        assert b"".join(data for _, data in parts).decode() == text


def test_every_character_class(pieces, library):
    """Letters and digits are those of the encoder's version of Unicode."""
    for start in range(0, 0x32000, 64):
        points = [c for c in range(start, start + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in points)
        assert ids_of(pieces, text) == library.encode_ordinary(text), hex(start)


def test_every_token_of_the_vocabulary(pieces, library):
    assert len(pieces.token) == 50_256
    for token in pieces.token[::7]:
        text = token.decode("utf-8", "ignore")
        assert ids_of(pieces, text) == library.encode_ordinary(text)


def test_long_texts_in_runs(pieces, library, monkeypatch):
    monkeypatch.setattr(bytepieces, "RUN", 50)
    text = "It's 12 words, é and 中文 too.\n\n " * 40
    assert ids_of(pieces, text) == library.encode_ordinary(text)
    assert ids_of(pieces, "a" * 9_000) == library.encode_ordinary("a" * 9_000)


def test_tokens_that_merges_do_not_reach():
    """A pre-token that is a token is taken whole, as the library does."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xy": 257}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    import base64
    import tempfile
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as file:
        for token, rank in ranks.items():
            file.write(base64.b64encode(token) + f" {rank}\n".encode())
        file.flush()
        pieces = bytepieces.Pieces(file.name, bytepieces.splitters(public_tokenizers.PATTERN))
        for text in ("abc", "abcd", "xy abc xyz", "abc!abc"):
            assert ids_of(pieces, text) == library.encode_ordinary(text)


def test_ranks_with_gaps_are_refused():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="0, 1, 2"):
        bytepieces.model_file(ranks | {b"ab": 300})
    with pytest.raises(ValueError, match="no token"):
        bytepieces.model_file({b"a": 0})


def test_memory_is_bounded_and_keeps_what_is_asked_for():
    memory = Memory(100_000)
    for k in range(200):
        words = [f"w{k}-{j}" for j in range(20)] + ["hot"]
        new = memory.missing(words)
        assert ("hot" in new) == (k == 0)
        memory.put(new, [b""] * len(new))
        assert set(words) <= memory.now.keys()
    assert len(memory.now) + len(memory.before) < 100_000 / 250 + 50


def test_edge_rows(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bytepieces.read_ranks(PATH))
    rows = spark.createDataFrame(EDGE_ROWS, SCHEMA)
    found = bytepieces.encode_bytes(rows, PATH, public_tokenizers.PATTERN, with_ids=True)
    want = sorted((str(r[0]), library.encode_ordinary(r[1] or "")) for r in EDGE_ROWS)
    assert sorted((str(r.doc_id), r.ids) for r in found.collect()) == want
    back = bytepieces.decode_bytes(found, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.data.decode()) for r in back) == sorted(
        (str(r[0]), r[1] or "") for r in EDGE_ROWS)
    empty = spark.createDataFrame([], SCHEMA)
    assert bytepieces.encode_bytes(empty, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_op11_against_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(
        f"{SF_DIR}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op11_byte_pieces"](spark, SF_DIR).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (
            len(ids), ids_digest(ids), digest(text.encode()))
