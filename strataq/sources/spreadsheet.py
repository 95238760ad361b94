"""Sheets of .xlsx files as tables, from any store that Spark reads.

Such a file is a zip of XML parts. Each file is read by Spark as one binary row
and taken apart in a task, a sheet's rows as a stream; many files are many
tasks. Cells come as texts: shared, inline and formula texts as they are,
numbers as the file has them, truth values as True and False, dates (numbers
that have a date's format) as YYYY-MM-DD HH:MM:SS; errors and blanks are null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cut import stored
from ..operators.dictionary import SHEETS
from .ordinals import ROW_ORD

#: Rows of a sheet that go on together.
_ROWS = 1_000
# Numbers of built-in formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(element, name: str):
    return [x for x in element.iter() if _name(x.tag) == name]


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _text(element) -> str:
    """Of a text with or without runs; phonetic hints aren't part of it."""
    out = []
    for x in element:
        if _name(x.tag) == "t":
            out.append(x.text or "")
        elif _name(x.tag) == "r":
            out += [t.text or "" for t in x if _name(t.tag) == "t"]
    return "".join(out)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(x.get("numFmtId")) for x in _children(root, "numFmt") if re.search("[ymdhs]", _QUOTED.sub("", x.get("formatCode", "")).lower().replace("general", ""))}
    styles = [x for part in _children(root, "cellXfs") for x in part if _name(x.tag) == "xf"]
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId", "0")) in DATE_FORMATS | own}


def _date(number: str, first: datetime) -> str:
    days = float(number)
    if first.year == 1899 and days < 60:  # the format's calendar has a 29 February 1900
        days += 1
    return (first + timedelta(seconds=round(days * 86_400))).strftime("%Y-%m-%d %H:%M:%S")


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, number of the row (from 1) and its cells, in the order of the file."""
    book = zipfile.ZipFile(io.BytesIO(content))
    root, links = _part(book, "xl/workbook.xml"), _part(book, "xl/_rels/workbook.xml.rels")
    texts = _part(book, "xl/sharedStrings.xml")
    shared = [] if texts is None else [_text(x) for x in texts]
    dates = _date_styles(book)
    first = datetime(1904, 1, 1) if any(x.get("date1904") in ("1", "true") for x in _children(root, "workbookPr")) else datetime(1899, 12, 30)
    targets = {x.get("Id"): x.get("Target") for x in links}

    def value(cell) -> str | None:
        kind, found = cell.get("t", "n"), {_name(x.tag): x for x in cell}
        if kind == "inlineStr":
            return _text(found["is"]) if "is" in found else None
        raw = found["v"].text if "v" in found else None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return str(raw.strip() == "1")
        return _date(raw, first) if kind == "n" and int(cell.get("s", "0")) in dates else raw

    for sheet in _children(root, "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if _name(k) == "id" and k != "id")]
        number = 0
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, x in ElementTree.iterparse(part):
                if _name(x.tag) != "row":
                    continue
                number = int(x.get("r", number + 1))
                cells: list[str | None] = []
                for c in x:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value(c)
                yield sheet.get("name"), number, cells
                x.clear()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells (array of string): of all .xlsx files that the path names. A file that is none fails with its path."""
    fields = [("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1)):
                held: list[tuple] = []

                def out() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*held), fields)], [n for n, _ in fields])  # noqa: B023

                try:
                    for row in rows_of(content.as_py()):
                        held.append((at, *row))
                        if len(held) == _ROWS:
                            yield out()
                            held.clear()
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError) as x:
                    raise ValueError(f"{at} is no workbook: {x}") from x
                if held:
                    yield out()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row long, cells array<string>")


def _header(names: list[str | None]) -> list[str]:
    """Names of columns: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        own = (name or "").strip() or f"Unnamed: {i}"
        k = seen.get(own, 0)
        seen[own] = k + 1
        out.append(f"{own}.{k}" if k else own)
    return out


def sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each sheet of one workbook as a table: the first row names the columns, row_ord is the row's number in the sheet.

    Columns are texts, but for those of a dictionary's known sheets, which have their types (what can't be read as such is
    null). Rows without any value are left out.
    """
    every = stored(cells(spark, path))
    first = every.groupBy("sheet").agg(F.min(F.struct("row", "cells")).alias("first")).collect()  # one row a sheet
    out = {}
    for r in first:
        names = _header(r["first"]["cells"])
        types = {f.name: f.dataType for f in T._parse_datatype_string(SHEETS[r["sheet"]])} if r["sheet"] in SHEETS else {}
        own = every.where((F.col("sheet") == r["sheet"]) & (F.col("row") > r["first"]["row"]) & F.exists("cells", lambda c: c.isNotNull()))
        value = lambda i, n: F.get("cells", F.lit(i)).try_cast(types.get(n, T.StringType())).alias(n)  # noqa: B023, E731
        out[r["sheet"]] = own.select(*[value(i, n) for i, n in enumerate(names) if n != ROW_ORD], F.col("row").alias(ROW_ORD))
    return out
