"""Sheets (XLSX) as a source and a sink of Spark: row ranges are read, and parts written, by the tasks.

A workbook is a zip of XML. Each task reads one range of rows of one sheet, streaming, and of the
shared strings only those that its rows name; so a task holds its range and nothing else. What
stands before a range has to be unpacked to get there, so ranges are wide. The driver reads the
headings only. Values are text as stored: numbers as written, dates as their serial numbers,
booleans as TRUE and FALSE; absent cells are null. A schema given to the reader picks columns by heading.

Paths are of a folder that all executors mount. ``path`` may be a file, a folder or a pattern.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of a range, and rows that a sheet holds below its headings.
RANGE, MOST = 100_000, 1_048_575
_SHEET = "xl/worksheets/sheet{}.xml"


def workbooks(path: str) -> list[str]:
    found = glob.glob(os.path.join(path, "*.xlsx")) if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if not os.path.basename(f).startswith(("_", ".", "~")))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    """Place of a cell by its reference: A1 is 0, AA1 is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _rows(book: zipfile.ZipFile, sheet: int, first: int, last: int | None) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
    """Number and cells (type, content) of the rows ``first`` up to but without ``last``; the headings' row is 1."""
    with book.open(_SHEET.format(sheet)) as f:
        number, place, cells, root = 0, -1, {}, None
        for event, node in iterparse(f, ("start", "end")):
            tag = _local(node.tag)
            if event == "start":
                root = node if tag == "sheetData" else root
                if tag == "row":
                    number, place, cells = int(node.get("r", number + 1)), -1, {}
                    if last is not None and number >= last:
                        return
                continue
            if tag == "c":
                place = _column(node.get("r")) if node.get("r") else place + 1
                kind = node.get("t", "n")
                text = "".join(x.text or "" for x in node.iter() if _local(x.tag) == ("t" if kind == "inlineStr" else "v"))
                if number >= first and (text or kind == "inlineStr"):
                    cells[place] = (kind, text)
            elif tag == "row":
                if number >= first:
                    yield number, cells
                root.clear()


def _shared(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared strings of these numbers."""
    out: dict[int, str] = {}
    if not wanted:
        return out
    with book.open("xl/sharedStrings.xml") as f:
        at, root = 0, None
        for event, node in iterparse(f, ("start", "end")):
            if event == "start":
                root = node if root is None else root
            elif _local(node.tag) == "si":
                if at in wanted:
                    # readings that stand beside a text (rPh) are no part of it
                    runs = [node] + [x for x in node if _local(x.tag) == "r"]
                    out[at] = "".join(t.text or "" for r in runs for t in r if _local(t.tag) == "t")
                at += 1
                root.clear()
    return out


def _table(path: str, sheet: int, first: int, last: int | None) -> list[tuple[int, dict[int, str]]]:
    with zipfile.ZipFile(path) as book:
        held = list(_rows(book, sheet, first, last))
        shared = _shared(book, {int(v) for _, cells in held for k, v in cells.values() if k == "s"})
    read = lambda k, v: shared[int(v)] if k == "s" else ("FALSE", "TRUE")[v == "1"] if k == "b" else v
    return [(n, {at: read(k, v) for at, (k, v) in cells.items()}) for n, cells in held]


def headings(path: str, sheet: int = 1) -> list[str]:
    """Texts of the first row; nameless columns are ``_c<place>``."""
    some = _table(path, sheet, 1, 2)
    cells = some[0][1] if some else {}
    return [cells.get(i) or f"_c{i}" for i in range(max(cells, default=-1) + 1)]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int | None


class SheetReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, sheet: int, width: int):
        self.schema, self.path, self.sheet, self.width = schema, path, sheet, width

    def partitions(self) -> list[Range]:
        out = []
        for path in workbooks(self.path):
            with zipfile.ZipFile(path) as book, book.open(_SHEET.format(self.sheet)) as f:
                found = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', f.read(4096))
            starts = list(range(2, max(3, int(found[1]) + 1 if found else 3), self.width))
            # the last range is open, should the sheet be longer than it says
            out += [Range(path, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        names = headings(part.path, self.sheet)
        at = [names.index(f.name) if f.name in names else None for f in self.schema.fields]
        for _, cells in _table(part.path, self.sheet, part.first, part.last):
            if cells:
                yield tuple(None if i is None else cells.get(i) for i in at)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
# what XML can't hold
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


class SheetWriter(DataSourceWriter):
    """Each part is a workbook of its own (more than one where its rows don't fit a sheet); they take their names when all are done."""

    def __init__(self, schema: StructType, path: str, name: str, most: int):
        self.names, self.path, self.name, self.most, self.job = schema.names, path, name, most, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files, book, sheet, n = [], None, None, 0

        def line(values) -> bytes:
            cells = ("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>' for v in values)
            return f"<row>{''.join(cells)}</row>".encode()

        def close() -> None:
            sheet.write(b"</sheetData></worksheet>")
            sheet.close()
            book.close()

        for row in rows:
            if book is None or n == self.most:
                if book is not None:
                    close()
                files.append(os.path.join(self.path, f"_{self.job}-{uuid.uuid4().hex}.xlsx"))
                book, n = zipfile.ZipFile(files[-1], "w", zipfile.ZIP_DEFLATED), 0
                for part, body in _PARTS.items():
                    book.writestr(part, _HEAD + body.replace("{name}", escape(self.name, {'"': "&quot;"})))
                sheet = book.open(_SHEET.format(1), "w", force_zip64=True)
                sheet.write(f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'.encode() + line(self.names))
            sheet.write(line(row))
            n += 1
        if book is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        done = [f for m in messages if m is not None for f in m.files]
        for i, f in enumerate(done):
            os.replace(f, os.path.join(self.path, f"part-{i:05d}-{self.job}.xlsx"))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes what tasks that failed or ran twice left."""
        for f in glob.glob(os.path.join(self.path, f"_{self.job}-*.xlsx")):
            os.remove(f)


class Sheets(DataSource):
    """``spark.read.format("sheet")``; options ``path``, ``sheet`` (its number), ``rows`` (of a range), ``name`` and ``most`` when written."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        books = workbooks(self.options["path"])
        if not books:
            raise FileNotFoundError(self.options["path"])
        return StructType([StructField(h, StringType()) for h in headings(books[0], int(self.options.get("sheet", 1)))])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(schema, self.options["path"], int(self.options.get("sheet", 1)), int(self.options.get("rows", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(schema, self.options["path"], self.options.get("name", "Plan1"), int(self.options.get("most", MOST)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sheets)
