"""What the text operators share: words, bindings inside a row, row keys, column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import materialize

# Bits of the set of keys that apart() hands to all tasks: 8 MB, whatever the number of keys.
KEY_BITS = 1 << 26

# ---- fixed values: the characters that separate words, and the same as patterns -------------
OTHER_BLANK = r"[\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# -------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column with exactly this name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once for the row.

    A lambda that mentions a plain expression computes it again for every element; one that
    mentions the variable of an enclosing lambda does not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def full_text(column: str) -> Column:
    """The text, null being empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; a text without a word gives an empty array."""
    spaced = F.regexp_replace(text, OTHER_BLANK, " ")
    return F.filter(F.split(spaced, " "), lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def doc_columns(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only what an operator needs, under fixed names, so that other columns cannot clash."""
    return docs.select(named(id_col).alias("doc_id"), full_text(text_col).alias("text"),
                       *[named(c).alias(c) for c in more])


def apart(rows: DataFrame, key: Column, listed: DataFrame,
          listed_key: Column) -> tuple[DataFrame, DataFrame]:
    """`rows` whose key (a 64-bit hash) may be among the listed ones, and those whose is not.

    The keys become bits of a set of fixed size, the only thing handed to all tasks. So a join that
    changes few of many wide rows moves those and, with very many keys, some more, but none of the
    others; how it runs does not depend on the size of either side.
    """
    def place(hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(KEY_BITS)) + 1

    set_bits = listed.select(place(listed_key).alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    set_bits = materialize(set_bits, "key-bits")
    bucket, bits, at = (unused_name(rows, n) for n in ("key_bucket", "key_bits", "key_at"))
    set_bits = F.broadcast(set_bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))
    marked = rows.withColumn(at, place(key))
    marked = marked.withColumn(bucket, F.bitmap_bucket_number(at)).join(set_bits, bucket, "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10)
    held = F.coalesce(F.getbit(byte.cast("int"), (bit % 8).cast("int")) == 1, F.lit(False))
    columns = [named(c) for c in rows.columns]
    return marked.where(held).select(*columns), marked.where(~held).select(*columns)
