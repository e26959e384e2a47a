"""Token counts by a deterministic transducer compiled from a piece vocabulary.

Reading a text character by character, the last token of the encoding of what was read so far is
the one piece ending here that stays apart from its predecessor when both are encoded together. So
a state holds, for each place where a piece may still be open, the piece's beginning, the last
token before it and the token count there less the count here. A piece has few characters and few
of its ends begin another, so these states are finitely many; each transition is annotated with
the change of the token count. States and transitions are compiled when first met and kept.

A space mark behind another character always begins a token. There the machine is back in its
start state, whatever it read before; so the state map of a chunk is an open head, a count and an
open tail, and chunk maps compose associatively: (h1, c1, t1)(h2, c2, t2) = (h1, c1 + |t1 h2| + c2,
t2). Long texts are cut into chunks whose maps are computed by any task and composed by a scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.bpe import sha256
from furrow.llm.common import doc_columns
from furrow.session import ship_package

CHUNK = 65_536
TOKEN_LIMIT = 4_096
SPACE = "▁"
NEVER = float("-inf")
# Compiled states and remembered segments of a worker; beyond that it compiles anew.
MOST_STATES, MOST_SEGMENTS, LONGEST_SEGMENT = 200_000, 1_000_000, 32

# A run of space marks and what follows up to the next one.
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Counts(dict):
    """Segments with their counts, computed when first asked for."""

    def __init__(self, run: Callable[[str], int]):
        super().__init__()
        self.run = run

    def __missing__(self, segment: str) -> int:
        found = self.run(segment)
        if len(segment) <= LONGEST_SEGMENT:
            if len(self) >= MOST_SEGMENTS:
                self.clear()
            self[segment] = found
        return found


class Transducer:
    """Counts tokens of text in which spaces are marks already."""

    _of: dict[str, Transducer] = {}

    def __init__(self, scores: dict[str, float]):
        if any(SPACE in piece.lstrip(SPACE) for piece in scores):
            raise ValueError("a piece has a space mark behind another character")
        self.scores = scores
        self.beginnings = {piece[:k] for piece in scores for k in range(1, len(piece))}
        self._apart: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        # A line break that no piece has is a token of its own and sets the machine back, too.
        self.lines = not any("\n" in piece for piece in scores)
        self.segments = _Counts(self._run)
        self.clear()

    def clear(self) -> None:
        start = (("", "", 0),)
        self.states: dict[tuple, int] = {start: 0}
        self.content: list[tuple] = [start]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    @classmethod
    def at(cls, path: str) -> Transducer:
        if path not in cls._of:
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = range(model.get_piece_size())
            cls._of[path] = cls({
                model.id_to_piece(i): model.get_score(i) for i in ids
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                        or model.is_unused(i))})
        return cls._of[path]

    # ---- compilation ------------------------------------------------------------------------

    def _pair_scores(self, parts: list[str]) -> list[float]:
        return [self.scores.get(one + next_, NEVER) for one, next_ in zip(parts, parts[1:])]

    def _join(self, parts: list[str], scores: list[float], place: int) -> None:
        """Merge the parts at `place` and behind it, and keep the scores of pairs in step."""
        parts[place:place + 2] = [parts[place] + parts[place + 1]]
        del scores[place]
        for k in range(max(place - 1, 0), min(place + 1, len(scores))):
            scores[k] = self.scores.get(parts[k] + parts[k + 1], NEVER)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short string: best pair first, leftmost among equals."""
        parts = list(text)
        scores = self._pair_scores(parts)
        while scores and (best := max(scores)) > NEVER:
            self._join(parts, scores, scores.index(best))
        return parts

    def _is_token(self, piece: str) -> bool:
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = len(piece) == 1 or (
                piece in self.scores and self._merged(piece) == [piece])
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        found = self._apart.get((left, right))
        if found is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            found = self._apart[left, right] = self._none_crosses(left, right)
        return found

    def _none_crosses(self, left: str, right: str) -> bool:
        """Whether no merge, best pair first, joins the two tokens or parts of them."""
        parts, border = list(left + right), len(left)
        scores = self._pair_scores(parts)
        while scores and (best := max(scores)) > NEVER:
            place = scores.index(best)
            if place == border - 1:
                return False
            border -= place < border
            self._join(parts, scores, place)
        return len(parts) == 2

    def _weight(self, token: str) -> int:
        """Tokens that a piece counts for: a character without a piece falls back to bytes."""
        return 1 if token in self.scores else len(token.encode("utf-8", "surrogatepass"))

    def _move(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change of the count, compiled when first taken."""
        opened = [(begun + char, last, count) for begun, last, count in self.content[state]]
        # Longest first; exactly one fits.
        for token, last, count in opened:
            if self._is_token(token) and (not last or self._stay_apart(last, token)):
                break
        change = count + self._weight(token)
        content = (*((begun, last, count - change) for begun, last, count in opened
                     if begun in self.beginnings), ("", token, 0))
        number = self.states.get(content)
        if number is None:
            number = self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
        self.moves[state][char] = number, change
        return number, change

    # ---- running ----------------------------------------------------------------------------

    def _run(self, segment: str) -> int:
        if len(self.content) > MOST_STATES:
            self.clear()
        state = count = 0
        moves = self.moves
        for char in segment:
            step = moves[state].get(char)
            if step is None:
                step = self._move(state, char)
            state = step[0]
            count += step[1]
        return count

    def count(self, text: str) -> int:
        """Tokens of whole segments: each begins in the start state."""
        if self.lines and "\n" in text:
            parts = text.split("\n")
            return sum(map(self.count, filter(None, parts))) + (
                len(parts) - 1) * self._weight("\n")
        return sum(map(self.segments.__getitem__, _SEGMENT.findall(text)))

    # ---- chunk maps -------------------------------------------------------------------------

    def chunk_map(self, text: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, resets): what lies before the first and behind the last reset."""
        resets = [m.end() for m in re.finditer(f"[^{SPACE}](?={SPACE})", text)]
        if not resets:
            return text, 0, "", False
        return (text[:resets[0]], self.count(text[resets[0]:resets[-1]]), text[resets[-1]:],
                True)

    def compose(self, one: tuple, other: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if one[3] and other[3]:
            middle = self.count(one[2] + other[0])
            return one[0], one[1] + middle + other[1], other[2], True
        if one[3]:
            # The open parts may meet in a reset.
            inner = self.chunk_map(one[2] + other[0])
            if inner[3]:
                return (one[0], one[1] + self.count(inner[0]) + inner[1], inner[2], True)
            return one[0], one[1], one[2] + other[0], True
        inner = self.chunk_map(one[0] + other[0])
        if not other[3]:
            return inner
        if inner[3]:
            return (inner[0], inner[1] + self.count(inner[2]) + other[1], other[2], True)
        return inner[0], other[1], other[2], True

    def closed(self, chunk: tuple) -> int:
        """The count of a whole text from its map."""
        return self.count(chunk[0]) + chunk[1] + self.count(chunk[2])


def scan(machine: Transducer, maps: list[tuple]) -> tuple:
    """The composition of neighbouring maps, by halves."""
    while len(maps) > 1:
        paired = [machine.compose(maps[k], maps[k + 1]) for k in range(0, len(maps) - 1, 2)]
        maps = paired + maps[len(paired) * 2:]
    return maps[0]


def marked(text: str) -> str:
    """Text as the machine reads it: marks for spaces, one before a text that has characters."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    Null counts as the empty text, which has no token; characters without a piece count for their
    bytes. Repeated rows give repeated results, other columns are not read, and an empty table
    gives an empty result. Texts longer than `chunk` characters are cut, their chunk maps computed
    by whichever tasks get them and composed per text; what moves is open heads and tails.
    """
    ship_package(docs.sparkSession)
    rows = doc_columns(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_bytes long, n_tokens long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.at(path)
        for batch in batches:
            counts = [machine.count(marked(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                key, text = sha256(text), marked(text)
                for number, start in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(k, 1).select(["doc_id", "n_bytes"]).columns,
                         pa.array([key]), pa.array([number], pa.int32()),
                         pa.array([text[start:start + chunk]])],
                        ["doc_id", "n_bytes", "key", "chunk", "text"])

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.at(path)
        for batch in batches:
            maps = [machine.chunk_map(t.as_py()) for t in batch.column("text")]
            head, count, tail, resets = map(list, zip(*maps))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "n_bytes", "key", "chunk"]).columns, pa.array(head),
                 pa.array(count, pa.int64()), pa.array(tail), pa.array(resets)],
                ["doc_id", "n_bytes", "key", "chunk", "head", "count", "tail", "resets"])

    def compose_chunks(group: pd.DataFrame) -> pd.DataFrame:
        machine = Transducer.at(path)
        copies = int((group["chunk"] == 0).sum())
        ordered = group.drop_duplicates("chunk").sort_values("chunk")
        maps = list(ordered[["head", "count", "tail", "resets"]].itertuples(
            index=False, name=None))
        row = {"doc_id": group["doc_id"].iloc[0], "n_bytes": int(group["n_bytes"].iloc[0]),
               "n_tokens": machine.closed(scan(machine, maps))}
        return pd.DataFrame([row] * copies)

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_text = F.length("text") > chunk
    short = sized.where(~long_text).mapInArrow(whole, result)
    cut_schema = f"doc_id {kind}, n_bytes long, key string, chunk int"
    maps = sized.where(long_text).mapInArrow(cut, cut_schema + ", text string").repartition(
        "key", "chunk").mapInArrow(
        map_chunks, cut_schema + ", head string, count long, tail string, resets boolean")
    composed = maps.groupBy("doc_id", "key").applyInPandas(compose_chunks, result)
    return short.unionByName(composed).select(
        "*", (F.col("n_tokens") > limit).alias("over_limit"))
