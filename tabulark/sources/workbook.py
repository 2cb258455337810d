"""Workbooks (XLSX, XLSM, ODS) without any library: zipped XML, read one sheet at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detection import MOST_COLUMNS

MOST_SHEETS, MOST_CELLS = 256, 100_000_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def number_text(value: str, is_date: bool = False) -> str:
    """A cell's number as text: dates in ISO form, whole numbers without a fraction."""
    x = float(value)
    if is_date:
        if x < 1:
            return (datetime(1900, 1, 1) + timedelta(seconds=round(x * 86400))).strftime("%H:%M:%S")
        at = datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))
        return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def _xlsx(book: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list[str]]]]:
    names = set(book.namelist())
    strings = []
    if "xl/sharedStrings.xml" in names:
        strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
        custom = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
        shows = lambda i: int(i) in _DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(i, "")), re.I))
        dates = [shows(x.get("numFmtId", "0")) for x in root.find(f"{_MAIN}cellXfs") or ()]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}

    def rows(path: str) -> Iterator[list[str]]:
        cells = 0
        for _, row in ElementTree.iterparse(book.open(path)):
            if row.tag != f"{_MAIN}row":
                continue
            out: list[str] = []
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else i
                out += [""] * (at + 1 - len(out))
                v, kind = c.findtext(f"{_MAIN}v"), c.get("t")
                if kind == "s" and v is not None:
                    out[at] = strings[int(v)]
                elif kind == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "b":
                    out[at] = "TRUE" if v == "1" else "FALSE"
                elif kind == "str":
                    out[at] = v or ""
                elif kind != "e" and v is not None:
                    style = int(c.get("s", 0))
                    out[at] = number_text(v, style < len(dates) and dates[style])
            cells += len(out)
            if cells > MOST_CELLS:
                raise ValueError(f"a sheet has more than {MOST_CELLS} cells")
            if any(out):
                yield out
            row.clear()

    for sheet in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(_REL)]
        yield sheet.get("name"), rows(target.lstrip("/") if target.startswith("/") else f"xl/{target}")


def _ods_text(cell) -> str:
    """The paragraphs of a cell, without its notes."""
    out = []
    for p in cell.findall(f"{_TEXT}p"):
        pieces = [p.text or ""]
        for e in p.iter():
            if e is not p:
                mark = {f"{_TEXT}s": " " * int(e.get(f"{_TEXT}c", 1)), f"{_TEXT}tab": "\t", f"{_TEXT}line-break": "\n"}.get(e.tag, e.text or "")
                pieces += [mark, e.tail or ""]
        out.append("".join(pieces))
    return " ".join(out)


def _ods_row(row) -> list[str]:
    out: list[str] = []
    for cell in row:
        kind = cell.get(f"{_OFFICE}value-type")
        if kind in ("float", "currency", "percentage"):
            text = number_text(cell.get(f"{_OFFICE}value"))
        elif kind == "date":
            text = cell.get(f"{_OFFICE}date-value", "").replace("T", " ")
        elif kind == "boolean":
            text = cell.get(f"{_OFFICE}boolean-value", "").upper()
        else:
            text = _ods_text(cell)
        times = int(cell.get(f"{_TABLE}number-columns-repeated", 1))
        if text and len(out) + times > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        out += [text] * min(times, MOST_COLUMNS)
    while out and not out[-1]:
        out.pop()
    return out


def _ods(book: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Sheets in one pass over the events of the content; a row's elements go when it is read."""
    events = ElementTree.iterparse(book.open("content.xml"), events=("start", "end"))

    def rows(table) -> Iterator[list[str]]:
        cells, depth = 0, 1
        for event, e in events:
            if e.tag == f"{_TABLE}table":  # a table in a cell has rows of its own, which aren't the sheet's
                depth += 1 if event == "start" else -1
                if not depth:
                    return
            elif e.tag == f"{_TABLE}table-row" and depth == 1:
                if event == "start":
                    continue
                out = _ods_row(e)
                times = int(e.get(f"{_TABLE}number-rows-repeated", 1))
                table.clear()
                cells += len(out) * times
                if cells > MOST_CELLS:
                    raise ValueError(f"a sheet has more than {MOST_CELLS} cells")
                for _ in range(times if out else 0):
                    yield out

    for event, e in events:
        if event == "start" and e.tag == f"{_TABLE}table":
            name, own = e.get(f"{_TABLE}name"), rows(e)
            yield name, own
            for _ in own:  # what the reader left
                pass


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(name, rows of texts) of each sheet; rows without a value are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    found = _ods(book) if "content.xml" in book.namelist() else _xlsx(book)
    for i, sheet in enumerate(found):
        if i >= MOST_SHEETS:
            raise ValueError(f"more than {MOST_SHEETS} sheets")
        yield sheet


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, line, cells): workbooks are parsed on executors, a file a row."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                for name, rows in sheets(content):
                    part: list[tuple] = []
                    for i, cells in enumerate(rows):
                        part.append((file, name, i, cells))
                        if len(part) == 8192:
                            yield pd.DataFrame(part, columns=["path", "sheet", "line", "cells"])
                            part = []
                    if part:
                        yield pd.DataFrame(part, columns=["path", "sheet", "line", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, sheet string, line long, cells array<string>").withColumn("width", F.size("cells"))
