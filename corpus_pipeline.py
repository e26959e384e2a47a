"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal,
source mixing and tokens, each stage over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.bpe import encode_documents
from furrow.llm.common import WORD
from furrow.llm.jaccard import one_of_each
from furrow.llm.lines import without_repeated_lines
from furrow.llm.mixing import mixed_documents
from furrow.llm.queries import vocabulary
from furrow.llm.rules import passing
from furrow.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; a document of nothing else goes.

    n_chars follows the text.
    """
    cut = without_repeated_lines(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return cut.where(~changed | F.col("text").rlike(WORD)).select(
        "doc_id", "text", "lang", "source",
        F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias(
            "n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the decoded text."""
    return encode_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]
# Near duplicates and BPE are beyond SQL; a brute-force version stands in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
