"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import model as M
from furrow.functions.text import quoted
from furrow.session import materialize
from furrow.sources.dialects import UTF8, csv_contents, csv_dialects, header_problems

# Written before the first column name, it makes every part file begin with the bytes EF BB BF.
BOM = "\ufeff"
CORRUPT = "_corrupt_record"
# A quote inside quotes is doubled.
QUOTE = '"'
# Formats that no text has, so that dates stay text as the profile reports them.
NEVER = "'#'"


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None,
             encoding: str | None = None, schema: T.StructType | str | None = None,
             multiline: bool | None = None) -> DataFrame:
    """A headered CSV file or folder, strictly: a row that does not fit stops the read.

    Without a dialect or schema these are found first: the dialect from the first bytes of the
    files, which must agree, and the types by a pass over the data. Give a schema for big data.
    Headers are always checked, and all bytes must decode. `multiline` allows line breaks inside
    quotes; a file can then not be divided among tasks. Where it is not said, it is set when such
    breaks are found.
    """
    delimiter, encoding = _dialect(spark, path, delimiter, encoding)
    multiline = _checked_contents(spark, path, encoding, multiline)
    reader = _reader(spark, delimiter, encoding, multiline).option("mode", "FAILFAST")
    if schema is None:
        schema = _widened(reader.option("inferSchema", "true").csv(path).schema)
    return reader.option("inferSchema", "false").schema(schema).csv(path)


def _widened(schema: T.StructType) -> T.StructType:
    """Whole numbers are 64 bits wide, whatever the values seen so far."""
    return T.StructType([
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType)
        for f in schema
    ])


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType,
                          delimiter: str = ",", encoding: str = UTF8,
                          header: bool = True) -> DataFrame:
    """All rows, those that do not fit with their text in `_corrupt_record`.

    The parsed rows are stored as a working table first: whether a row fits is only known when
    all of its columns are parsed, so a query on the raw file must not prune any of them.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = _reader(spark, delimiter, encoding, False).options(mode="PERMISSIVE", header=header)
    parsed = reader.option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    return materialize(parsed, "parsed")


def corrupt_rows(parsed: DataFrame) -> DataFrame:
    """The text of the rows that were set aside."""
    return parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def sound_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",",
              bom: bool = True) -> None:
    """CSV part files that spreadsheet tools recognize as UTF-8 by their first bytes."""
    if bom and header:
        first = df.columns[0]
        df = df.select(quoted(first).alias(BOM + first), *[quoted(c) for c in df.columns[1:]])
    df.write.options(
        header=header, sep=delimiter, encoding="UTF-8", quote=QUOTE, escape=QUOTE,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def _reader(spark: SparkSession, delimiter: str, encoding: str, multiline: bool):
    if encoding != UTF8:
        # Spark reads charsets beyond the Unicode ones only under this setting.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.options(
        header=True, sep=delimiter, encoding=encoding, multiLine=multiline, enforceSchema=False,
        quote=QUOTE, escape=QUOTE,
        dateFormat=NEVER, timestampFormat=NEVER, timestampNTZFormat=NEVER, preferDate=False,
    )


def _dialect(spark: SparkSession, path: str, delimiter: str | None,
             encoding: str | None) -> tuple[str, str]:
    found = csv_dialects(spark, path, delimiter=delimiter, encoding=encoding).persist()
    try:
        problems = header_problems(found).limit(5).collect()
        if problems:
            listed = ", ".join(f"{p['problem']}: {p['path']}" for p in problems)
            raise M.PreparationError(f"CSV files cannot be read ({listed})")
        kinds = found.select("delimiter", "encoding").distinct().limit(2).collect()
    finally:
        found.unpersist()
    if len(kinds) != 1:
        raise M.PreparationError("the files are of no or of several dialects; read them apart")
    return delimiter or kinds[0]["delimiter"], encoding or kinds[0]["encoding"]


def _checked_contents(spark: SparkSession, path: str, encoding: str,
                      multiline: bool | None) -> bool:
    """Refuses files with bytes outside the encoding; says whether quotes hold line breaks."""
    seen = csv_contents(spark, path, encoding).agg(
        F.count_if(~F.col("decodes")).alias("bad"),
        F.min(F.when(~F.col("decodes"), F.col("path"))).alias("first"),
        F.coalesce(F.bool_or("quoted_breaks"), F.lit(False)).alias("breaks")).head()
    if seen["bad"]:
        raise M.PreparationError(
            f"{seen['bad']} CSV files have bytes that are not {encoding}, as {seen['first']}")
    return seen["breaks"] if multiline is None else multiline
