"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.archive import archived_pages
from furrow.llm.bpe import encode_documents
from furrow.llm.bytepieces import encode_bytes
from furrow.llm.codes import vector_codes
from furrow.llm.common import table
from furrow.llm.exact import exact_copies
from furrow.llm.jaccard import jaccard_links
from furrow.llm.licenses import license_scan
from furrow.llm.lines import line_dedup
from furrow.llm.mixing import mix
from furrow.llm.ordinal import fit, graded, label_grade
from furrow.llm.rules import quality_verdicts
from furrow.llm.search import ranked_search
from furrow.llm.transducer import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        return run
    return add


@query("op1_exact_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"), keep="largest")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("failed_rules")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_bpe_round_trip")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op4_archive_conversion")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@query("op8_source_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents")).drop("mark")


@query("op5_ordinal_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graded(docs, fit(docs, table(spark, sf_dir, "labels"), label_grade()))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op11_byte_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return encode_bytes(table(spark, sf_dir, "documents"),
                        vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_vector_codes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


@query("op13_ranked_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
