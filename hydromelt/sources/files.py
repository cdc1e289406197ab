"""Reading agency files into one cell-grid table.

Files differ in encoding, header position and width, so they are read as rows
of texts; header detection and naming are DataFrame operators. Ordinary files
are parsed one per task. CSV files above ``WHOLE_FILE_BYTES`` are read by line
instead and split over many tasks.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import config as C
from hydromelt import schemas
from hydromelt.functions.values import any_of
from hydromelt.operators.joins import checked_broadcast
from hydromelt.sources import lines

_BATCH_ROWS = 20_000
_MISSING = frozenset(C.MISSING_CELL_TEXTS)
_GRID_SCHEMA = pa.schema([("file_id", pa.string()), ("encoding", pa.string()), ("ragged", pa.bool_()),
                          ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])
_GRID_COLUMNS = _GRID_SCHEMA.names


def _suffixes(suffixes: tuple[str, ...]) -> str:
    return "(?i)(" + "|".join(re.escape(s) for s in suffixes) + ")$"


def plain_path(path: Column) -> Column:
    """A metadata path, which comes percent-encoded, as the file system spells it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _hidden(name: Column) -> Column:
    return any_of([name.startswith(prefix) for prefix in C.SKIPPED_NAME_PREFIXES])


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Data files below a folder with their size; lock files and dotfiles are left out.

    The content column is only read by plans that select it.
    """
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1)))
    return found.where(F.col("filename").rlike(_suffixes(C.DATA_SUFFIXES)) & ~_hidden(F.col("filename")))


def content_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", "filename", "length", F.sha2("content", 256).alias("sha256"))


def is_excel(name: Column) -> Column:
    return name.rlike(_suffixes(C.EXCEL_SUFFIXES))


def decode(content: bytes) -> tuple[str | None, str | None]:
    """(text, encoding) under the first encoding that fits; (None, None) if none does."""
    for encoding in C.CSV_ENCODINGS:
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return None, None


def _csv_rows(text: str) -> Iterator[list[str | None]]:
    csv.field_size_limit(sys.maxsize)
    for row in csv.reader(io.StringIO(text, newline="")):
        if row and not (len(row) == 1 and not row[0].strip()):
            yield [None if cell in _MISSING else cell for cell in row]


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}


def _column_index(reference: str) -> int:
    index = 0
    for ch in reference:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - 64
    return index - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_SHEET}numFmt")
           if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    styles = root.find(f"{_SHEET}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else [])
            if int(xf.get("numFmtId", 0)) in _DATE_FORMAT_IDS | own}


def _first_sheet(book: zipfile.ZipFile) -> str:
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in links}
    sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
    target = targets[sheet.get(_REL)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _number_cell(text: str, is_date: bool) -> str:
    number = float(text)
    if is_date:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400)))
    return str(int(number)) if number.is_integer() else str(number)


def _xlsx_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet; numbers and dates as their plain texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in root.iter(f"{_SHEET}si")]
        dates = _date_styles(book)
        expected = 1
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_SHEET}row":
                    continue
                at = int(row.get("r", expected))
                for _ in range(expected, at):
                    yield []
                expected = at + 1
                cells: list[str | None] = []
                for cell in row.iter(f"{_SHEET}c"):
                    index = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (index + 1 - len(cells))
                    value, kind = cell.find(f"{_SHEET}v"), cell.get("t", "n")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    elif value is None or value.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "n":
                        text = _number_cell(value.text, int(cell.get("s", 0)) in dates)
                    elif kind == "b":
                        text = str(value.text == "1")
                    else:
                        text = value.text
                    cells[index] = None if text in _MISSING else text
                yield cells
                row.clear()


def _file_rows(name: str, content: bytes) -> tuple[str | None, Iterator[list[str | None]] | None]:
    if name.lower().endswith(C.EXCEL_SUFFIXES):
        return (None, _xlsx_rows(content)) if zipfile.is_zipfile(io.BytesIO(content)) else (None, None)
    text, encoding = decode(content)
    return encoding, None if text is None else _csv_rows(text)


def _grid_batch(file_id: str, encoding: str | None, first: int, rows: list[list[str | None]], width: int) -> pa.RecordBatch:
    """One Arrow batch of grid rows, short rows padded to the file's width."""
    wide = [len(cells) > width for cells in rows]
    padded = [cells if len(cells) >= width else cells + [None] * (width - len(cells)) for cells in rows]
    return pa.RecordBatch.from_arrays([
        pa.repeat(pa.scalar(file_id, pa.string()), len(rows)), pa.repeat(pa.scalar(encoding, pa.string()), len(rows)),
        pa.array(wide, pa.bool_()), pa.array(range(first, first + len(rows)), pa.int64()),
        pa.array(padded, pa.list_(pa.string()))], names=_GRID_COLUMNS)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file_id, name, content in zip(*(batch.column(c) for c in ("file_id", "filename", "content"))):
            encoding, rows = _file_rows(name.as_py(), content.as_py())
            if rows is None:
                # Unreadable: one row without cells, so that the file is reported.
                yield pa.RecordBatch.from_pylist([{
                    "file_id": file_id.as_py(), "encoding": None, "ragged": False, "row_idx": -1, "cells": None}],
                    schema=_GRID_SCHEMA)
                continue
            first, width = 0, 0
            while part := list(islice(rows, _BATCH_ROWS)):
                width = width or next((len(cells) for cells in part if cells), 0)
                yield _grid_batch(file_id.as_py(), encoding, first, part, width)
                first += len(part)


def read_cells(files: DataFrame) -> DataFrame:
    """Cell grid of whole files: (file_id, encoding, ragged, row_idx, cells).

    A file no encoding fits gives one row with ``row_idx`` -1 and null cells.
    ``ragged`` marks rows wider than the first row of their file.
    """
    part = files.select(F.col("path").alias("file_id"), "filename", "content")
    return part.mapInArrow(_parse_files, schemas.CELLS)


def _large_csv(length: Column, name: Column, whole_bytes: int) -> Column:
    return (length > whole_bytes) & ~is_excel(name)


def read_lines(spark: SparkSession, folder: str, whole_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(cell grid, unsplittable files) of the large CSV files of a folder, split inside files."""
    meta = F.col("_metadata")
    name = plain_path(meta["file_name"])
    text = (spark.read.options(recursiveFileLookup=True, lineSep="\n").text(folder)
            .where(_large_csv(meta["file_size"], name, whole_bytes) & name.rlike(_suffixes(C.DATA_SUFFIXES))
                   & ~_hidden(name)))
    return lines.read_lines(text.select(plain_path(meta["file_path"]).alias("file_id"), meta["file_block_start"].alias("block"),
                                        F.col("value").cast("binary").alias("line")))


def read_folder(spark: SparkSession, folder: str, whole_bytes: int = C.WHOLE_FILE_BYTES) -> DataFrame:
    """Cell grid of all data files of a folder, large CSV files split over tasks."""
    files = discover(spark, folder)
    large = _large_csv(F.col("length"), F.col("filename"), whole_bytes)
    if files.where(large).select("path").isEmpty():
        return read_cells(files)
    grid, unsplittable = read_lines(spark, folder, whole_bytes)
    unsplittable = unsplittable.select(F.col("file_id").alias("path"))
    few = files.where(large).join(checked_broadcast(unsplittable), "path", "left_semi")
    return read_cells(files.where(~large)).unionByName(read_cells(few)).unionByName(grid)


def unreadable(cells: DataFrame) -> DataFrame:
    """Files no encoding fitted."""
    return cells.where("cells is null").select("file_id").distinct()
