"""Registered text queries against their SQL, or a brute-force version where SQL cannot say it."""

import collections
import hashlib
import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, difference
from test_edges_llm import maximal_runs, without
from furrow.llm import bpe, ordinal, transducer
from furrow.llm.oracles import ORACLES
from furrow.llm.queries import QUERIES, vocabulary

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grams(text):
    w = WORD.findall(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(texts):
    """(class id, links) per document, from all pairs."""
    sets = {i: grams(t) for i, t in texts.items()}
    holders = collections.defaultdict(list)
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in holders[g])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: (top(i), links[i]) for i in texts}


def without_runs(texts, least=50):
    """Texts without later copies of maximal runs of lines with `least` words."""
    ids = sorted(texts)
    runs = maximal_runs([texts[i] for i in ids], least, overlap=False)
    return {i: (without(texts[i], gone), len(gone)) for i, gone in zip(ids, runs)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(spark, connect(SF_DIR), name, SF_DIR) is None


def test_op3_against_library(spark, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    found = {r.doc_id: r for r in QUERIES["op3_bpe_round_trip"](spark, SF_DIR).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids))),
            sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_op5_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = ordinal.fit(docs, labels.where("doc_id % 4 != 1"), ordinal.label_grade())
    rows = ordinal.graded(docs, model).join(
        labels.where("doc_id % 4 = 1").withColumn("grade", ordinal.label_grade()),
        "doc_id").collect()
    assert list(model.thresholds) == sorted(model.thresholds)
    clean = [r.selected for r in rows if r.grade == 2]
    junk = [r.selected for r in rows if r.grade == 0]
    assert sum(clean) / len(clean) > 0.97
    assert sum(junk) / len(junk) < 0.1
    assert all(r.p_ge_1 >= r.p_ge_2 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9
               for r in rows)


def test_op5_query(spark, texts):
    rows = QUERIES["op5_ordinal_quality"](spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == texts.keys()


def test_op7_against_brute_force(spark, texts):
    found = {r.doc_id: (r.text or "", r.n_removed)
             for r in QUERIES["op7_line_dedup"](spark, SF_DIR).collect()}
    assert found == without_runs(texts)


def test_op9_against_brute_force(spark, texts):
    found = {r.doc_id: (r.class_id, r.n_links)
             for r in QUERIES["op9_ngram_jaccard_join"](spark, SF_DIR).collect()}
    assert found == linked(texts)


def test_op10_against_library(spark, texts):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit)
             for r in QUERIES["op10_token_counts"](spark, SF_DIR).collect()}
    for i, text in texts.items():
        n = len(model.encode(text))
        assert found[i] == (len(text.encode()), n, n > 4096)


def test_pipeline_against_brute_force(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    verdict = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, SF_DIR).collect() if r.kept}
    kept = {i: t for i, t in texts.items() if i in verdict}
    cut = {i: t for i, (t, n) in without_runs(kept).items() if not n or WORD.search(t)}
    single = {i: cut[i] for i, (top, _) in linked(cut).items() if i == top}
    stage = docs
    for (name, run), want in zip(corpus_pipeline.STAGES, (kept, cut, single)):
        stage = run(spark, stage, SF_DIR).cache()
        assert stage.columns == docs.columns, name
        assert {r.doc_id: r.text for r in stage.collect()} == want, name
    mixed = corpus_pipeline.STAGES[3][1](spark, stage, SF_DIR).cache()
    assert mixed.columns == docs.columns
    words = {i: len(WORD.findall(t)) for i, t in single.items()}
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(single) and max(times.values()) <= 2
    total = sum(words[i] * n for i, n in times.items())
    assert abs(total - 1.5 * sum(words.values())) < 20 * max(words.values())
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, SF_DIR).collect()
    assert collections.Counter(r.doc_id for r in tokens) == times
    assert all(r.n_tokens == len(r.ids) and sha(" ".join(map(str, r.ids))) == r.ids_sha256
               for r in tokens)


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names
    assert bpe.LEAF > 0 and transducer.CHUNK > 0
