"""Column expressions over text: trimming, strict numbers, identifiers, row tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: the characters that Unicode text stripping removes at both ends ----------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A plain decimal number; rejects what Java alone would accept: 1d, 1f, NaN, Infinity, padding.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NULL_MARK = "\u0001"
# -------------------------------------------------------------------------------------------


def normalize_category(value: Column) -> Column:
    """Text form of a category, stripped at both ends; null stays null."""
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def strict_double(value: Column, dtype: T.DataType) -> Column:
    """Double value of a column, null where text is not a plain number."""
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(NUMBER), value.try_cast("double"))
    if isinstance(dtype, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    return value.cast("string").try_cast("double")


def rejected_number(value: Column, dtype: T.DataType) -> Column:
    """True where a present value cannot be read as a number."""
    return value.isNotNull() & strict_double(value, dtype).isNull()


def finite_double(value: Column, dtype: T.DataType) -> Column:
    """The value as a double; null for text that is no number, NaN and infinite values."""
    number = strict_double(value, dtype)
    # A difference with itself is zero for finite numbers only.
    return F.when(number - number == 0, number)


def column_id(name: Column) -> Column:
    """Lower-case hex of the UTF-8 bytes of a column name."""
    return F.lower(F.hex(F.encode(name, "UTF-8")))


def keyed_token(keys: Iterable[Column], seed: int) -> Column:
    """A pseudo-random but reproducible token of a row, from its key and the seed."""
    parts = [F.coalesce(k.cast("string"), F.lit(NULL_MARK)) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def exact_text(value: Column, dtype: T.DataType) -> Column:
    """Text that two values share exactly if they are equal; null has one of its own.

    Numbers and times print all their digits, both zeros are one, and every part of a nested value
    is preceded by its length, so no separator can be mistaken.
    """
    if isinstance(dtype, T.StructType):
        text = F.concat(F.lit(""), *[_with_length(exact_text(value[f.name], f.dataType))
                                     for f in dtype.fields])
    elif isinstance(dtype, T.ArrayType):
        text = F.concat(F.lit(""), F.array_join(F.transform(
            value, lambda x: _with_length(exact_text(x, dtype.elementType))), ""))
    elif isinstance(dtype, T.MapType):
        entry = T.StructType([T.StructField("key", dtype.keyType),
                              T.StructField("value", dtype.valueType)])
        text = exact_text(F.array_sort(F.map_entries(value)), T.ArrayType(entry))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = F.when(value == 0, "0").otherwise(value.cast("string"))
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(value)
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(NULL_MARK))


def _with_length(text: Column) -> Column:
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def whole_row_token(schema: T.StructType, names: Iterable[str]) -> Column:
    """A token over the exact values of these columns; equal rows share it."""
    parts = [_with_length(exact_text(quoted(n), schema[n].dataType)) for n in names]
    return F.md5(F.concat(F.lit(""), *parts).cast("binary"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def quoted(name: str) -> Column:
    """The column with exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
