"""Workbook files out of a table, as input for the workbook reader."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame

from furrow.sources.storage import create_binary

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def write_workbooks(df: DataFrame, book: Column, path: str) -> None:
    """One file per value of `book`, which must bound the rows of a file; written by tasks."""
    names = df.columns

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["_book"].iloc[0])
        with create_binary(f"{path}/book-{number}.xlsx") as stream:
            stream.write(_workbook(rows[names]))
        return pd.DataFrame({"book": [number]})

    (df.withColumn("_book", book).groupBy("_book").applyInPandas(write, "book bigint")
     .write.format("noop").mode("overwrite").save())


def _workbook(rows: pd.DataFrame) -> bytes:
    lines = [_row([escape(c) for c in rows.columns], True)]
    lines += [_row(values, False) for values in rows.itertuples(index=False)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>'
                      '<sheet name="rows" sheetId="1" r:id="s1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">'
                      '<Relationship Id="s1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>'
                      + "".join(lines) + "</sheetData></worksheet>")
    return buffer.getvalue()


def _row(values, header: bool) -> str:
    cells = []
    for value in values:
        if header or isinstance(value, str):
            cells.append(f'<c t="inlineStr"><is><t>{value if header else escape(value)}</t></is></c>')
        else:
            cells.append(f"<c><v>{value!r}</v></c>" if value == value else "<c/>")
    return "<row>" + "".join(cells) + "</row>"
