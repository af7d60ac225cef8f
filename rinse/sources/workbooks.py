"""XLSX workbooks as tables of strings.

A workbook is a zip archive and cannot be split, so the unit of work is one workbook: Spark
lists and fetches the files (any file system it knows), and each task turns the workbooks it
was given into rows, a batch at a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import SOURCE_READ_ERROR, RinseError, first_line

_BATCH_ROWS = 4096
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# Number formats that are dates without saying so, and the letters of those that do.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_DATE_LETTERS = re.compile(r"[dmyhs]", re.IGNORECASE)


def read_xlsx(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """The first sheet of every workbook, with the headers of all as columns.

    The headers are read in a job of their own; columns a workbook lacks are null.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
            .option("recursiveFileLookup", recursive)
            .load(path)
        )
        return read_workbooks(files)
    except PySparkException as error:
        message = f"Cannot read {path}: {first_line(error)}"
        raise RinseError(SOURCE_READ_ERROR, message) from error


def read_workbooks(files: DataFrame) -> DataFrame:
    """The same for a table ``(path, content)`` of workbooks."""
    files = files.select("path", "content")
    names = _header(files)
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return files.mapInArrow(_rows_in(names), schema) if names else files.select()


def _header(files: DataFrame) -> list[str]:
    """All column names: those of the first workbook by path, then what others add."""
    seen = files.mapInArrow(_headers, "path string, at int, name string")
    first = seen.groupBy("name").agg(F.min(F.struct("path", "at")).alias("place"))
    return [row["name"] for row in first.orderBy("place").collect()]


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, content in _files(batches):
        names = column_names(next(sheet_rows(path, content), []))
        columns = [[path] * len(names), list(range(len(names))), names]
        types = [pa.string(), pa.int32(), pa.string()]
        arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "at", "name"])


def _rows_in(wanted: list[str]):
    """Rows under the wanted columns, placed by each workbook's own header."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in _files(batches):
            table = sheet_rows(path, content)
            places = {name: at for at, name in enumerate(column_names(next(table, [])))}
            picked = [places.get(name) for name in wanted]
            while chunk := list(islice(table, _BATCH_ROWS)):
                arrays = [
                    pa.array(
                        [None if at is None or at >= len(row) else row[at] for row in chunk],
                        pa.string(),
                    )
                    for at in picked
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=wanted)

    return rows


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.column(0)[at].as_py(), batch.column(1)[at].as_py()


def column_names(header: list[str | None]) -> list[str]:
    """Names for a header row: blank cells at the end go, repeated names get their position."""
    while header and not header[-1]:
        header = header[:-1]
    named = [name or f"_c{at}" for at, name in enumerate(header)]
    folded = [name.lower() for name in named]
    return [
        f"{name}{at}" if folded.count(name.lower()) > 1 else name for at, name in enumerate(named)
    ]


def sheet_rows(path: str, content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet. Empty rows in between count, as lists of nothing."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        texts = _shared_texts(archive)
        dates = _date_styles(archive)
        expected = 1
        with archive.open(_first_sheet(archive)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if _tag(node) == "row":
                    number = int(node.get("r", expected))
                    yield from ([] for _ in range(expected, number))
                    yield _row(node, texts, dates)
                    expected = number + 1
                    node.clear()
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as error:
        raise ValueError(f"{path} is not a readable workbook: {error}") from error


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _first_sheet(archive: zipfile.ZipFile) -> str:
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    wanted = next(node.get(_RELATION) for node in book.iter() if _tag(node) == "sheet")
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(node.get("Target") for node in links if node.get("Id") == wanted)
    return posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")


def _text(node: ElementTree.Element) -> str:
    """The text of a plain or formatted string, without pronunciation marks."""
    parts = []
    for child in node:
        if _tag(child) == "t":
            parts.append(child.text or "")
        elif _tag(child) == "r":
            parts.append(_text(child))
    return "".join(parts)


def _shared_texts(archive: zipfile.ZipFile) -> list[str]:
    texts = []
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as strings:
            for _, node in ElementTree.iterparse(strings):
                if _tag(node) == "si":
                    texts.append(_text(node))
                    node.clear()
    return texts


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    formats = set(_DATE_FORMATS)
    for node in root.iter():
        if _tag(node) == "numFmt":
            shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", ""))
            if _DATE_LETTERS.search(shown):
                formats.add(int(node.get("numFmtId")))
    styles = next((node for node in root if _tag(node) == "cellXfs"), [])
    return {at for at, style in enumerate(styles) if int(style.get("numFmtId", 0)) in formats}


def _row(node: ElementTree.Element, texts: list[str], dates: set[int]) -> list[str | None]:
    values: list[str | None] = []
    for cell in node:
        letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
        at = len(values)
        if letters:
            at = 0
            for letter in letters:
                at = at * 26 + ord(letter) - 64
            at -= 1
        values.extend([None] * (at - len(values)))
        values.append(_value(cell, texts, dates))
    return values


def _value(cell: ElementTree.Element, texts: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text(child) for child in cell if _tag(child) == "is"), None)
    raw = next((child.text for child in cell if _tag(child) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind != "n":
        return raw
    if int(cell.get("s", 0)) in dates:
        # Day 0 of the spreadsheet calendar, as it counts a 29 February 1900.
        day = datetime(1899, 12, 30) + timedelta(days=float(raw))
        return (day + timedelta(microseconds=500)).replace(microsecond=0).isoformat()
    return raw if re.fullmatch(r"-?\d+", raw) else repr(float(raw))
