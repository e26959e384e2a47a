"""How Spark types are named in profiles and grouped for counting."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: names under which the types appear in a profile -------------------------
TYPE_NAMES = {
    T.ByteType: "Int8",
    T.ShortType: "Int16",
    T.IntegerType: "Int32",
    T.LongType: "Int64",
    T.FloatType: "Float32",
    T.DoubleType: "Float64",
    T.DecimalType: "Decimal",
    T.StringType: "String",
    T.BooleanType: "Boolean",
    T.DateType: "Date",
    T.TimestampType: "Datetime",
    T.TimestampNTZType: "Datetime",
    T.ArrayType: "List",
    T.NullType: "Unknown",
}
NUMERIC_PREFIXES = ("Int", "UInt", "Float", "Decimal")
STRING_NAMES = ("String", "Utf8")
UNSTABLE_NAMES = ("Object", "Unknown")
NESTED_NAMES = ("List", "Object", "Unknown")
# -------------------------------------------------------------------------------------------


def type_name(dtype: T.DataType) -> str:
    return TYPE_NAMES.get(type(dtype), "Object")


def count_type(dtype: T.DataType) -> str | None:
    """The type in which distinct values of a column are counted; None if they are not."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.StringType, T.DecimalType)):
        return "string"
    if isinstance(dtype, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dtype.simpleString()
    return None


def comparable(dtype: T.DataType) -> bool:
    return count_type(dtype) is not None
