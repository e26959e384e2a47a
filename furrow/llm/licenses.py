"""Licence scan: entire texts are brought to a canonical form and looked up by its digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import doc_columns, let
from furrow.llm.license_texts import NOTICES, SPELLINGS, TEXTS

# ---- fixed values: lines that name an owner, and what separates words -----------------------
COPYRIGHT_LINE = (r"^[^\p{L}\p{N}©(]*((copyright\s*)?(©|\(c\))|copyright\s+([0-9<\[{]|by )"
                  r"|copyright\s*$|all rights reserved)")
SEPARATORS = r"[^\p{L}\p{N}]+"
# An owner statement in a line that goes on with a text or notice, and the words these begin with.
OWNER = r"((copyright\s*)?(©|\(c\)\s*(?=[0-9<\[{]))|copyright\s*\(c\)|copyright\s+([0-9<\[{]|by ))"
OPENINGS = (r"(permission is hereby granted|permission to use, copy|redistribution and use in source"
            r"|this software is provided|everyone is permitted to copy"
            r"|(this work is )?licen[sc]ed under |released under |spdx-license-identifier)")
# Items of lists in known texts that only look like an owner.
LIST_ITEM = r"^\s*\(c\)\s+(you must retain|under patent claims)"
# -------------------------------------------------------------------------------------------


def canonical_line(line: Column) -> Column:
    """A line in lower case, words apart by one space, without owners and variant spellings.

    An owner statement is cut up to the words that begin a known text or notice, if some follow in
    its line, else the whole line is the statement.
    """
    return let(F.lower(line), lambda lowered: let(_without_owners(lowered), _plain_line))


def _without_owners(lowered: Column) -> Column:
    """The line in pieces that begin with an opening; all pieces but the last lose their owner to the end."""
    pieces = F.split(lowered, rf"(?=\b{OPENINGS})")
    cut = let(pieces, lambda p: F.array_join(F.transform(p, lambda piece, i: F.when(
        i < F.size(p) - 1, F.regexp_replace(piece, rf"{OWNER}[^\n]*$", " ")).otherwise(piece)), ""))
    named = lowered.contains("copyright") | lowered.contains("(c)") | lowered.contains("©")
    return F.when(named, cut).otherwise(lowered)


def _plain_line(lowered: Column) -> Column:
    words = F.concat(F.lit(" "), F.regexp_replace(lowered, SEPARATORS, " "), F.lit(" "))
    for variant, standard in SPELLINGS:
        words = F.replace(words, F.lit(f" {variant} "), F.lit(f" {standard} "))
    return F.when(lowered.rlike(COPYRIGHT_LINE) & ~lowered.rlike(LIST_ITEM), "").otherwise(
        F.trim(words))


def _canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda line: line != "")


def _digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_digests(spark: SparkSession, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(license_id, digest) of the canonical forms of these texts, one row per digest."""
    rows = spark.createDataFrame(list(texts), "license_id string, text string")
    return rows.select("license_id", _digest(F.array_join(
        _canonical_lines(F.col("text")), " ")).alias("digest")).groupBy("digest").agg(
        F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 texts: Sequence[tuple[str, str]] = TEXTS,
                 notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of `docs`: doc_id, canonical_sha256, license_id, notice_ids.

    license_id is that of the known text whose canonical form the whole document has, null if
    none; notice_ids names the licences, sorted and apart by commas, for which some whole line
    stands. Null counts as the empty text, which no licence has; repeated rows are looked up each
    for itself, other columns are not read, and an empty table gives an empty result. The known
    digests come from the given texts, so both joins have a side of that size.
    """
    spark = docs.sparkSession

    def found(lines: Column) -> Column:
        return F.struct(
            _digest(F.array_join(lines, " ")).alias("digest"),
            F.array_sort(F.array_distinct(F.filter(F.transform(
                F.array_intersect(F.transform(lines, _digest), F.array(
                    *[F.lit(d) for d in by_digest] or [F.lit(None).cast("string")])),
                lambda d: F.try_element_at(ids, d)), lambda x: x.isNotNull()))).alias("notices"))

    # A bounded table of the given notices: its digests become literals of the projection.
    by_digest = {r["digest"]: r["license_id"] for r in known_digests(spark, notices).collect()}
    ids = F.create_map(*[F.lit(x) for pair in by_digest.items() for x in pair]) if by_digest else (
        F.create_map().cast("map<string,string>"))
    scanned = doc_columns(docs, id_col, text_col).select(
        "doc_id", let(_canonical_lines(F.col("text")), found).alias("f"))
    known = known_digests(spark, texts)
    return scanned.select("doc_id", F.col("f.digest").alias("digest"), "f.notices").join(
        F.broadcast(known), "digest", "left").select(
        "doc_id", F.col("digest").alias("canonical_sha256"), "license_id",
        F.array_join("notices", ",").alias("notice_ids"))
