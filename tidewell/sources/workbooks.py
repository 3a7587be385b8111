"""Readers of XLSX workbooks: price histories with one to three header rows, and upstream prices on a named sheet.

A workbook is a zip archive of XML parts, of at most 2^20 rows a sheet; each is read by one task, a row at a time. What
comes of its cells (headers, types, cleaning) is DataFrame work.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.shipping import ship
from tidewell.sources.files import RAW, clean_raw

# Fixed values of the format: namespaces, and the built-in number formats that are dates.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATES = {*range(14, 23), *range(45, 48)}

_SCHEMA = "file string, line int, cells array<string>"


def _texts(node: ET.Element) -> str:
    """The text of a string item; phonetic readings don't count."""
    return "".join(t.text or "" for run in node for t in ([run] if run.tag == f"{_MAIN}t" else run.findall(f"{_MAIN}t") if run.tag == f"{_MAIN}r" else []))


def _column(name: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", name)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dates = _DATES | {k for k, code in own.items() if re.search("[ymdhs]", code, re.IGNORECASE)}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> tuple[str | None, bool]:
    """(part of the named sheet, or of the one that is shown first, whether days count from 1904); no part if there is no such sheet."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    flags = root.find(f"{_MAIN}workbookPr")
    late = flags is not None and flags.get("date1904") in ("1", "true")
    sheets = list(root.iter(f"{_MAIN}sheet"))
    view = next(root.iter(f"{_MAIN}workbookView"), None)
    active = int(view.get("activeTab", 0)) if view is not None else 0
    found = [s for s in sheets if s.get("name") == sheet] if sheet else sheets[active : active + 1]
    if not found:
        return None, late
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets[found[0].get(f"{_OFFICE}id")]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", late


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(line, cells as text) of a sheet's rows; dates as ISO stamps, numbers as they are written, blank cells null.

    A workbook without the sheet has no rows; what is no zip archive raises BadZipFile.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, late = _sheet_part(book, sheet)
        if part is None:
            return
        shared = [_texts(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        dates, origin = _date_styles(book), dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)

        def value(c: ET.Element) -> str | None:
            kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
            if kind == "inlineStr":
                inner = c.find(f"{_MAIN}is")
                return _texts(inner) if inner is not None else None
            if v is None:
                return None
            if kind == "s":
                return shared[int(v)]
            if kind == "b":
                return "True" if v == "1" else "False"
            if kind == "n" and int(c.get("s", 0)) in dates:
                return (origin + dt.timedelta(seconds=round(float(v) * 86400))).isoformat()
            return v

        line = 0
        with book.open(part) as xml:
            for _, node in ET.iterparse(xml):
                if node.tag != f"{_MAIN}row":
                    continue
                line = int(node.get("r", line + 1))
                cells: list[str | None] = []
                for c in node.findall(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [value(c)]
                yield line, cells
                node.clear()


def sheet_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(file, line, cells) of the rows with a cell of all workbooks in files (file, content); the first sheet shown, or the named one.

    A file that is no workbook has one row, of line 0 and null cells; one without the sheet, or with an empty one, has none.
    """

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                out: list[tuple] = []
                try:
                    for line, cells in rows_of(bytes(content) if content is not None else b"", sheet):
                        if any(c is not None for c in cells):
                            out.append((name, line, cells))
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=["file", "line", "cells"])
                            out = []
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    out = [(name, 0, None)]
                if out:
                    yield pd.DataFrame(out, columns=["file", "line", "cells"])

    ship(files.sparkSession)
    return files.select("file", "content").mapInPandas(work, _SCHEMA)


def read_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """sheet_cells() of the files below a path."""
    return sheet_cells(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), sheet)


def history_rows(cells: DataFrame, first: str = RAW[0]) -> DataFrame:
    """Raw history rows (file, line, the eight columns) behind the headers: line 1, and each of lines 2 and 3 that is blank, or starts with a blank or `first`."""
    head = lambda n: F.max(F.when(F.col("line") == n, F.coalesce(F.col("cells")[0] != first, F.lit(False)))).alias(f"_{n}")
    body = cells.where("cells is not null").where("line > 0")
    # whether a line is data; the sheet's last row counts as no header is looked for behind it
    known = body.groupBy("file").agg(head(2), head(3))
    skip = F.when(F.coalesce("_2", F.lit(False)), 1).when(F.coalesce("_3", F.lit(False)), 2).otherwise(3)
    kept = body.join(known.select("file", skip.alias("_skip")), "file").where("line > _skip")
    return kept.select("file", "line", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(RAW)], F.lit(None).cast("string").alias("_extra"))


def read_history(spark: SparkSession, path: str, brands: list[tuple[str, str]]) -> DataFrame:
    """Clean rows of raw price histories in workbooks, as read_raw gives of CSV files."""
    return clean_raw(history_rows(read_cells(spark, path)), brands)


def upstream_rows(cells: DataFrame, city: str = "Sydney") -> DataFrame:
    """(tgp_date, tgp) of an upstream sheet: the first row names the columns, the first column is the day, one column a city.

    Rows without a readable day are left out; a day without a price is null. No sheet or no such city is an error when rows are read.
    """
    heads = cells.where("line = 1").groupBy("file").agg(F.first("cells").alias("_names"))
    at = F.array_position("_names", city)
    whole = F.when((at > 1), at).otherwise(F.raise_error(F.lit(f"no column {city!r}: the layout may have changed")))
    body = cells.where("line > 1").join(heads, "file", "left").withColumn("_at", whole)
    day = F.to_date(text.parse_date(F.col("cells")[0]))
    rows = body.select(day.alias("tgp_date"), F.get("cells", F.col("_at").cast("int") - 1).try_cast("double").alias("tgp"))
    return rows.where("tgp_date is not null")


def workbook(rows: Iterable[Iterable], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with the rows from line 1 on: texts, numbers, dates; a row that is None is left out of the sheet."""
    def cell(v, at: str) -> str:
        if isinstance(v, dt.datetime):
            days = (v - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
            return f'<c r="{at}" s="1"><v>{days!r}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    body = "".join(
        f'<row r="{i}">' + "".join(cell(v, f"{letters(k)}{i}") for k, v in enumerate(row) if v is not None) + "</row>"
        for i, row in enumerate(rows, 1) if row is not None
    )
    main, office = _MAIN[1:-1], _OFFICE[1:-1]
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, xml in parts.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{xml}')
    return out.getvalue()
