"""Exact duplicates: grouped by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import doc_columns


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest",
                 digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text. The row with the
    smallest (or largest) id stays. Of rows that repeat both id and text exactly one is kept;
    null ids lose against any other, and a group with only null ids keeps one of its rows under
    a null keep_id. An empty table gives an empty result; other columns are not read.

    Copies collapse inside each task before the shuffle, so a group with a third of all rows
    arrives as one row per task. The grouping key holds the text itself: texts that share a
    digest but not their bytes stay apart. The result goes back to the rows over digests only.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    first = F.min if keep == "smallest" else F.max
    rows = doc_columns(docs, id_col, text_col).select(
        "doc_id", "text", digest(F.col("text")).alias("h"),
        F.unhex(F.sha2("text", 256)).alias("s"))
    same_bytes = rows.groupBy("h", "s", "text").agg(
        F.count("*").alias("n"), first("doc_id").alias("keep_id"))
    # Bytes that differ under one digest differ in `s` as well; both agreeing is refused.
    groups = same_bytes.groupBy("h", "s").agg(
        F.sum("n").alias("group_size"), first("keep_id").alias("keep_id"),
        F.count("*").alias("texts"),
    ).where(F.col("group_size") > 1).select(
        "h", "s", "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both digests")).cast(
            "long")).otherwise(F.col("group_size")).alias("group_size"))
    listed = rows.groupBy("doc_id", "h", "s").agg(F.count("*").cast("int").alias("copies"))
    joined = listed.join(groups.withColumnsRenamed({"keep_id": "best", "group_size": "size"}),
                         ["h", "s"], "left")
    single = F.col("size").isNull()
    stays = single | F.col("best").eqNullSafe(F.col("doc_id"))
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("copies")),
                              lambda k: (k == 1) & stays)).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"))
