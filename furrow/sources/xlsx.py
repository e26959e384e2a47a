"""Workbooks: the active sheet of every XLSX file in a folder, with cached formula values."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.profile import typed
from furrow.sources.storage import list_files, open_binary

# ---- fixed values: names of the office open XML format ---------------------------------------
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)
DAY_ZERO = datetime(1899, 12, 30)
# ----------------------------------------------------------------------------------------------

SCHEMA = ("path string, sheet string, row_number bigint, header array<string>, "
          "cells array<string>, error string")
ROWS_PER_BATCH = 2_000


def read_workbooks(spark: SparkSession, path: str, sample_rows: int | None = None) -> DataFrame:
    """(path, sheet, row_number, header, cells, error): data rows of each file's active sheet.

    Files are spread over tasks and streamed row by row. A file that cannot be ingested gives one
    row with `error` set. With `sample_rows`, only that many data rows of each file.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                yield from _frames(file, sample_rows)

    return list_files(spark, path, "*.xlsx", files_per_task=1).select("path").mapInPandas(
        read, SCHEMA)


def workbook_table(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows of workbooks with one header as a table of text columns."""
    wanted = F.array(*[F.lit(h) for h in header])
    return rows.where(F.col("error").isNull() & (F.col("header") == wanted)).select(
        *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)])


def workbook_frame(rows: DataFrame, header: list[str]) -> DataFrame:
    """The same table with numbers, booleans and dates where a whole column holds them."""
    return typed(workbook_table(rows, header), dates=True)


def _frames(path: str, sample_rows: int | None) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "row_number", "header", "cells", "error"]
    try:
        with open_binary(path) as stream:
            book = zipfile.ZipFile(io.BytesIO(stream.read()))
        sheet, part = _active_sheet(book)
        rows = _sheet_rows(book, part)
        header = [h.strip() if h else "" for h in next(rows, [])]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        yield pd.DataFrame([(path, None, 0, None, None, "not_a_workbook")], columns=names)
        return
    error = _header_error(header)
    if error:
        yield pd.DataFrame([(path, sheet, 0, header, None, error)], columns=names)
        return
    buffered = []
    for number, cells in enumerate(rows, start=1):
        if sample_rows is not None and number > sample_rows:
            break
        padded = (cells + [None] * len(header))[:len(header)]
        buffered.append((path, sheet, number, header, padded, None))
        if len(buffered) == ROWS_PER_BATCH:
            yield pd.DataFrame(buffered, columns=names)
            buffered = []
    if buffered:
        yield pd.DataFrame(buffered, columns=names)


def _header_error(header: list[str]) -> str | None:
    if not header:
        return "empty_sheet"
    if "" in header:
        return "blank_header"
    return "duplicate_header" if len(set(header)) < len(header) else None


def _active_sheet(book: zipfile.ZipFile) -> tuple[str, str]:
    """Name and archive member of the sheet that was open when the file was saved."""
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = tree.find(f"{MAIN}bookViews/{MAIN}workbookView")
    active = int(view.get("activeTab", "0")) if view is not None else 0
    sheet = tree.findall(f"{MAIN}sheets/{MAIN}sheet")[active]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in links}[sheet.get(LINK)]
    part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
    return sheet.get("name"), part


def _sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    shared, dated = _shared_strings(book), _date_styles(book)
    with book.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag == f"{MAIN}row":
                cells: list[str | None] = []
                for cell in row.findall(f"{MAIN}c"):
                    at = _position(cell.get("r"), len(cells))
                    cells += [None] * (at - len(cells))
                    cells.append(_cell_text(cell, shared, dated))
                yield cells
                row.clear()


def _position(reference: str | None, default: int) -> int:
    """Column number of a reference such as AB12."""
    if not reference:
        return default
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell_text(cell: ElementTree.Element, shared: list[str], dated: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    value = cell.find(f"{MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind in (None, "n") and int(cell.get("s", "0")) in dated:
        # A day number; rounded to milliseconds, the precision such numbers have.
        at = DAY_ZERO + timedelta(milliseconds=round(float(value.text) * 86_400_000))
        return at.isoformat(sep=" ")
    return value.text


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for custom in tree.iter(f"{MAIN}numFmt"):
        # Quoted text, escapes and bracketed colours do not count as date letters.
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", custom.get("formatCode", "")).lower()
        if re.search("[ymdhs]", code) and "general" not in code:
            dates.add(int(custom.get("numFmtId")))
    styles = tree.findall(f"{MAIN}cellXfs/{MAIN}xf")
    return {i for i, xf in enumerate(styles) if int(xf.get("numFmtId", "0")) in dates}


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    tree = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in tree]
