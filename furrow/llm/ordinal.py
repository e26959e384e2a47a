"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds t_1 < t_2 <
... turn a document's score s into P(grade >= k) = 1 / (1 + exp(t_k - s)). The fit reads a bounded
sample of rated documents, whole texts, in one task; scoring is a projection over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD, doc_columns, full_text, named
from furrow.session import ship_package

DIMENSIONS = 1 << 16
# The most rated documents that a fit reads; which ones is decided by a hash of the id.
SAMPLE = 6_000
STEPS, RATE, MOMENTUM, PENALTY = 400, 0.5, 0.95, 3e-5
# Features that fewer rated documents have are left out.
LEAST_DOCUMENTS = 5
# A word counts for the number of distinct words to minus this power.
WORD_POWER = 0.25
# A document is selected from the probability that this share of the best grade's rated documents
# misses, each scored by a fit without it; from SELECT_AT if none are rated.
SELECT_FROM, SELECT_AT, MISSED, FOLDS = 2, 0.4, 0.02, 2
REMEMBERED = 200_000
_WORDS = re.compile(WORD)


@dataclass(frozen=True)
class Model:
    """Weights by feature, one threshold per grade above the lowest, and where selection starts."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = SELECT_AT

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def _shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of one kind once."""
    out = ""
    for char in word:
        kind = ("A" if char.isupper() else "a") if char.isalpha() else "0" if char.isdigit() else char
        if not out.endswith(kind):
            out += kind
    return out[:12]


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


class _Slots(dict):
    """The feature slots of a word: the word without case and outer marks, and its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = (_slot("w:" + word.lower().strip(".,;:!?\"'()")),
                              _slot("s:" + _shape(word)))
        return found


_slots = _Slots()
_REPEAT, _FEW, _LINES = _slot("repeat"), _slot("distinct"), _slot("lines")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: its distinct words' features, and shares of repetition."""
    listed = _WORDS.findall(text)
    if not listed:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    distinct = set(listed)
    pairs = np.array([_slots[w] for w in distinct], dtype=np.int32)
    words, word_counts = np.unique(pairs[:, 0], return_counts=True)
    shapes, shape_counts = np.unique(pairs[:, 1], return_counts=True)
    slots = np.concatenate([words, shapes])
    values = np.concatenate([np.minimum(word_counts, 1) * len(distinct) ** -WORD_POWER,
                             3 * shape_counts / len(distinct)])
    again = sum(a == b for a, b in zip(listed, listed[1:])) / len(listed)
    lines = [line for line in text.split("\n") if line.strip()]
    extra = [again * 10, 3 * (1 - len(distinct) / len(listed)),
             3 * (1 - len(set(lines)) / max(1, len(lines)))]
    return (np.concatenate([slots, np.array([_REPEAT, _FEW, _LINES], np.int32)]),
            np.concatenate([values, extra]).astype(np.float32))


def fitted(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int) -> Model:
    """The maximum likelihood fit with a small ridge, by full-batch gradient steps with momentum.
    Gradients add up over documents, so features that many documents agree on move first.
    """
    # A fixed order, so that sums do not depend on how rows arrive.
    y = np.array([g for g, _, _ in rows], dtype=np.int64)
    size = np.array([len(s) for _, s, _ in rows], dtype=np.int64)
    of = np.repeat(np.arange(len(rows)), size)
    slot = np.concatenate([s for _, s, _ in rows]) if rows else np.zeros(0, np.int32)
    value = np.concatenate([v for _, _, v in rows]) if rows else np.zeros(0, np.float32)
    n = max(1, len(rows))
    common = np.bincount(slot, minlength=DIMENSIONS) >= LEAST_DOCUMENTS
    share = [(np.sum(y >= k) + 1) / (len(rows) + 2) for k in range(1, grades)]
    # Ordered by construction: the first threshold and the logarithms of the steps.
    first = -np.log(share[0] / (1 - share[0]))
    cuts = np.concatenate([[first], np.zeros(grades - 2)])
    w = np.zeros(DIMENSIONS)
    speed = np.zeros(DIMENSIONS + grades - 1)
    for _ in range(STEPS):
        t = np.concatenate([[cuts[0]], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
        s = np.bincount(of, value * w[slot], minlength=len(rows))
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(np.clip(s - edges[y + 1], -40, 40)))
            low = 1 / (1 + np.exp(np.clip(s - edges[y], -40, 40)))
        up, low = np.where(y == grades - 1, 1.0, up), np.where(y == 0, 0.0, low)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        by_score = (d_up - d_low) / n
        by_cut = np.array([(-d_up[y == k].sum() + d_low[y == k + 1].sum()) / n
                           for k in range(grades - 1)])
        by_step = np.concatenate([[by_cut.sum()], [
            by_cut[k:].sum() * np.exp(cuts[k]) for k in range(1, grades - 1)]])
        by_weight = np.bincount(slot, value * by_score[of], minlength=DIMENSIONS) * common
        speed = MOMENTUM * speed + np.concatenate([by_weight + PENALTY * w, by_step])
        w, cuts = w - RATE * speed[:DIMENSIONS], cuts - RATE * speed[DIMENSIONS:]
    return Model(w.astype(np.float32),
                 np.concatenate([[cuts[0]], cuts[0] + np.cumsum(np.exp(cuts[1:]))]))


def scores(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([float(model.weights[s] @ v) if len(s) else 0.0 for _, s, v in rows])


def chosen_cut(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int,
               select_from: int = SELECT_FROM) -> float:
    """The probability of `select_from` that the share MISSED of the best grade's rows is below."""
    found = []
    for fold in range(FOLDS):
        own = [r for r in rows[fold::FOLDS] if r[0] == grades - 1]
        others = [r for k, r in enumerate(rows) if k % FOLDS != fold]
        if own and others:
            model = fitted(others, grades)
            found.append(model.tails(scores(model, own))[:, select_from - 1])
    return float(np.quantile(np.concatenate(found), MISSED)) if found else SELECT_AT


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int = 3,
        id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on up to `sample` rated documents, those with the smallest hashes of their ids.

    `grade` is a column over `ratings`, from 0 to grades - 1; ratings without a grade or id are
    left out. Without any rating the weights are zero and all grades equally likely.
    """
    ship_package(docs.sparkSession)
    rated = ratings.select(named(id_col).alias("rated_id"), grade.cast("int").alias("grade")).where(
        f"rated_id IS NOT NULL AND grade BETWEEN 0 AND {grades - 1}")
    chosen = rated.orderBy(F.md5(F.col("rated_id").cast("string").cast("binary")), "rated_id",
                           "grade").limit(sample)
    # The sample has at most `sample` rows of two numbers.
    texts = docs.select(named(id_col).alias("doc_id"), full_text(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("rated_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["all"] * batch.num_rows), batch.column("doc_id").cast(pa.string()),
                 batch.column("grade"), pa.array([s for s, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.float32()))],
                ["part", "doc_id", "grade", "slots", "shares"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        # Whole documents of more than `sample` rated rows cannot arrive: ids may repeat.
        ordered = group.sort_values(["doc_id", "grade"]).head(sample)
        rows = [(int(g), s, v) for g, s, v in zip(
            ordered["grade"], ordered["slots"], ordered["shares"])]
        model = fitted(rows, grades)
        return pd.DataFrame({"weights": [model.weights.tolist()],
                             "thresholds": [model.thresholds.tolist()],
                             "cut": [chosen_cut(rows, grades)]})

    found = texts.mapInArrow(
        extract, "part string, doc_id string, grade int, slots array<int>, shares array<float>"
    ).groupBy("part").applyInPandas(
        train, "weights array<float>, thresholds array<double>, cut double").first()
    if found is None:
        return fitted([], grades)
    return Model(np.array(found["weights"], np.float32), np.array(found["thresholds"]),
                 found["cut"])


def graded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           select_from: int = SELECT_FROM, select_at: float | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, expected_grade, p_ge_1, p_ge_2, ..., selected.

    A document is selected if its grade is `select_from` or better with probability `select_at`,
    where none is given the cut that the fit chose for SELECT_FROM.
    Texts are read whole; null counts as empty, whose score is zero; repeated rows are graded each
    for itself; other columns are not read, and an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    rows = doc_columns(docs, id_col, text_col)
    names = [f"p_ge_{k + 1}" for k in range(len(model.thresholds))]
    kind = rows.schema["doc_id"].dataType.simpleString()
    weights, thresholds = model.weights, model.thresholds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                slots, values = features(text.as_py())
                scores[k] = float(weights[slots] @ values) if len(slots) else 0.0
            tails = own.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)),
                 *(pa.array(tails[:, k]) for k in range(tails.shape[1]))],
                ["doc_id", "expected_grade", *names])

    schema = f"doc_id {kind}, expected_grade double, " + ", ".join(f"{n} double" for n in names)
    return rows.mapInArrow(score, schema).select(
        "*", (F.col(names[select_from - 1]) >= (
            model.cut if select_at is None else select_at)).alias("selected"))


def label_grade() -> Column:
    """Grade of a label row: 0 for bad quality, 1 for good but toxic text, 2 for good text."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        F.col("quality") == 1, 2)
