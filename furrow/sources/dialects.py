"""Finding encoding, delimiter and header of CSV files from their first bytes."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import model as M
from furrow.session import ship_package
from furrow.sources.storage import blocks, list_files, open_binary

# ---- fixed values ----------------------------------------------------------------------------
DELIMITERS = ",;\t|"
DEFAULT_DELIMITER = ","
UTF8, CHINESE, WESTERN = "utf-8", "gb18030", "windows-1252"
CJK_FIRST, CJK_LAST = "\u3400", "\u9fff"
CJK_AT_LEAST = 2
CJK_SHARE = 0.02
# ----------------------------------------------------------------------------------------------

SCHEMA = ("path string, encoding string, delimiter string, header array<string>, "
          "error string")


def csv_dialects(spark: SparkSession, path: str, pattern: str | None = None,
                 delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """(path, encoding, delimiter, header, error) per file; each task reads 128 KiB of each.

    A delimiter or encoding that is given is taken for all files.
    """
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["path"]:
                with open_binary(file) as stream:
                    head = stream.read(M.DIALECT_BYTES)
                rows.append({"path": file, **describe(head, delimiter, encoding)})
            yield pd.DataFrame(rows, columns=["path", "encoding", "delimiter", "header", "error"])

    ship_package(spark)
    return list_files(spark, path, pattern).select("path").mapInPandas(probe, SCHEMA)


def csv_contents(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(path, decodes, quoted_breaks) per file, from all of its bytes.

    Files are streamed in blocks. A line break is inside quotes when an odd number of quotes is
    before it; neither is part of a longer character in any of the encodings.
    """
    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["path"]:
                decoder = codecs.getincrementaldecoder(encoding)()
                decodes, breaks, quotes = True, False, 0
                for block in blocks(file):
                    try:
                        decoder.decode(block)
                    except UnicodeDecodeError:
                        decodes = False
                        break
                    codes = np.frombuffer(block, np.uint8)
                    before = quotes + np.cumsum(codes == ord('"'))
                    breaks = breaks or bool((before[codes == ord("\n")] % 2).any())
                    quotes = int(before[-1]) % 2
                else:
                    decodes = _ends_whole(decoder)
                rows.append((file, decodes, breaks))
            yield pd.DataFrame(rows, columns=["path", "decodes", "quoted_breaks"])

    ship_package(spark)
    return list_files(spark, path, files_per_task=1).mapInPandas(
        inspect, "path string, decodes boolean, quoted_breaks boolean")


def _ends_whole(decoder: codecs.IncrementalDecoder) -> bool:
    try:
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return False
    return True


def describe(head: bytes, delimiter: str | None = None,
             encoding: str | None = None) -> dict[str, object]:
    """Dialect of a file given its first bytes; `error` says why there is none."""
    empty = {"encoding": None, "delimiter": None, "header": None}
    encoding = encoding or detect_encoding(head)
    if encoding is None:
        return {**empty, "error": "unknown_encoding"}
    text = _decode(head, encoding)
    if text is None:
        return {**empty, "encoding": encoding, "error": "not_in_encoding"}
    if not text.strip():
        return {**empty, "encoding": encoding, "error": "empty_file"}
    if delimiter is None:
        try:
            delimiter = csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter
        except csv.Error:
            delimiter = DEFAULT_DELIMITER
    header = next(csv.reader(io.StringIO(text), delimiter=delimiter), None)
    return {"encoding": encoding, "delimiter": delimiter, "header": header, "error": None}


def detect_encoding(head: bytes) -> str | None:
    """UTF-8 if valid, GB18030 if it reads as Chinese, else Windows-1252, else GB18030.

    A character cut off by the end of the sample is not an error.
    """
    if _decode(head, UTF8) is not None:
        return UTF8
    chinese = _decode(head, CHINESE)
    if chinese is not None:
        ideographs = sum(CJK_FIRST <= c <= CJK_LAST for c in chinese)
        letters = sum(map(str.isalnum, chinese)) or 1
        if ideographs >= CJK_AT_LEAST and ideographs >= CJK_SHARE * letters:
            return CHINESE
    if _decode(head, WESTERN) is not None:
        return WESTERN
    return CHINESE if chinese is not None else None


def _decode(head: bytes, encoding: str) -> str | None:
    decoder = codecs.getincrementaldecoder("utf-8-sig" if encoding == UTF8 else encoding)()
    try:
        return decoder.decode(head, final=len(head) < M.DIALECT_BYTES)
    except UnicodeDecodeError:
        return None


def header_problems(dialects: DataFrame) -> DataFrame:
    """(path, problem) of files whose header cannot name columns."""
    names = F.transform("header", lambda h: F.trim(h))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("header").isNull() | (F.size("header") == 0), "no_header")
        .when(F.exists(names, lambda h: h == ""), "blank_header")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_header")
    )
    return dialects.select("path", problem.alias("problem")).where("problem is not null")
