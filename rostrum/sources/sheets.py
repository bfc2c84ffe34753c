"""Workbooks (zipped XML) as input lists (SRC1, SRC3) and as reports (SNK1)."""
from __future__ import annotations

import io
import re
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rostrum.sources.cells import cell_text

CELLS = "file string, row_no int, col_no int, text string, result string, rich_text array<struct<text string>>"
BATCH = 8_192
#: The format's own limit of rows a sheet, the header among them.
MAX_ROWS = 1_048_576

# fixed values: names and addresses of the container format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_SHEET_ML = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


# --- reading --------------------------------------------------------------------------------
def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    return int(ref[len(letters):]), _column(letters)


def _decoded(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _string(item) -> tuple[str | None, list[dict] | None]:
    """Plain text, or the runs of a rich one; phonetic hints are neither."""
    runs = item.findall(f"{_MAIN}r")
    if runs:
        return None, [{"text": _decoded(r.findtext(f"{_MAIN}t") or "")} for r in runs]
    return _decoded(item.findtext(f"{_MAIN}t") or ""), None


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of one kind, one at a time; each is forgotten after its use."""
    with book.open(name) as part:
        parents = []
        for event, e in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == _MAIN + tag:
                yield e
                parents[-1].clear()


def _first_sheet(book: zipfile.ZipFile) -> str | None:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is None:
        return None
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == sheet.get(_REL_ID):
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _merged(book: zipfile.ZipFile, name: str) -> list[tuple[int, int, int, int]]:
    """Merged ranges (top, left, bottom, right), which the file states behind its rows."""
    found, rest = [], b""
    with book.open(name) as part:
        while block := part.read(1 << 20):
            rest += block
            refs = list(re.finditer(rb'<(?:\w+:)?mergeCell\s[^>]*?ref="([A-Z]+\d+):([A-Z]+\d+)"', rest))
            found += [(*_place(m[1].decode()), *_place(m[2].decode())) for m in refs]
            rest = rest[max(refs[-1].end() if refs else 0, len(rest) - 256):]
    return sorted(found)


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)


def _value(cell, shared: list) -> tuple[str | None, str | None, list[dict] | None]:
    """``(text, result, rich_text)`` of a cell; errors and cells without a value have none."""
    kind, v = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        item = cell.find(f"{_MAIN}is")
        text, rich = _string(item) if item is not None else (None, None)
        return text, None, rich
    if v is None or kind == "e":
        return None, None, None
    if kind == "s":
        text, rich = shared[int(v)]
        return text, None, rich
    plain = {"b": lambda: "true" if v.strip() == "1" else "false", "n": lambda: _number(v)}.get(kind, lambda: _decoded(v))()
    return (None, plain, None) if cell.find(f"{_MAIN}f") is not None else (plain, None, None)


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """``(row_no, col_no, text, result, rich_text)`` of the first sheet, by row.
    All cells of a merged range have the value of its first."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name = _first_sheet(book)
        if name is None:
            return
        shared = [_string(si) for si in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        ahead, open_, row_no = _merged(book, name), [], 0
        for row in _elements(book, name, "row"):
            row_no, col_no = int(row.get("r", row_no + 1)), 0
            open_ = [m for m in open_ if m[2] >= row_no]
            while ahead and ahead[0][0] <= row_no:
                open_.append(ahead.pop(0))
            for cell in row.iter(f"{_MAIN}c"):
                col_no = _place(cell.get("r"))[1] if cell.get("r") else col_no + 1
                value = _value(cell, shared)
                around = next((m for m in open_ if m[0] <= row_no <= m[2] and m[1] <= col_no <= m[3]), None)
                if value == (None, None, None) or (around and around[:2] != (row_no, col_no)):
                    continue
                top, left, bottom, right = around or (row_no, col_no, row_no, col_no)
                for r in range(top, bottom + 1):
                    for c in range(left, right + 1):
                        yield r, c, *value


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row_no", "col_no", "text", "result", "rich_text"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.struct([("text", pa.string())]))]

    def sent(file, held):
        columns = [pa.array(c, t) for c, t in zip(zip(*held), types)]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), *columns], names=["file", *names])

    for batch in batches:
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            held = []
            try:
                for cell in workbook_cells(content.as_py()):
                    held.append(cell)
                    if len(held) == BATCH:
                        yield sent(file, held)
                        held = []
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                raise ValueError(f"not a workbook: {file}: {e}") from e
            if held:
                yield sent(file, held)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """SRC1 + SRC3: ``(file, row_no, col_no, value)`` of the first sheet of each
    workbook below ``path`` (a file, a folder or a pattern, on any file system
    that Spark reads).

    Files are the unit of parallel work: a task unpacks one at a time and sends
    its cells on in batches, so it holds one packed file and that file's shared
    strings.  Rich text is joined, a link gives its text and a formula its
    stored result; errors and empty cells give no row.  A file that is no
    workbook ends the job with its name.  Use ``cells.sheet_rows(.., "file")``
    for the companies and people of many lists at once.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True)
             .load(path).select("path", "content"))
    value = cell_text(F.struct("text", "result", "rich_text"))
    return files.mapInArrow(_read, CELLS).select("file", "row_no", "col_no", value.alias("value")).where("value <> ''")


# --- writing --------------------------------------------------------------------------------
def _encoded(value) -> str:
    """Characters that XML does not allow, and text that looks like their code, by their code."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", str(value))
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ud800-\udfff￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _cell(value, style: str = "") -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 10 ** 15:  # what the format's numbers hold exactly
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"{style}><is><t xml:space="preserve">{_encoded(value)}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _write_book(out, sheet: str, columns: list[str], rows: Iterable[tuple]) -> None:
    """One workbook of ``rows`` below a bold, fixed header with filters."""
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                      f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET_ML}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEET_ML}.styles+xml"/>'
                      f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEET_ML}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
                      f'<Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
                      '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            part.write((f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
                        f'<sheetData><row>{"".join(_cell(c, " s=\"1\"") for c in columns)}</row>').encode())
            for row in rows:
                part.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                n += 1
            part.write(f'</sheetData><autoFilter ref="A1:{_letters(len(columns))}{n + 1}"/></worksheet>'.encode())


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        self.path, self.sheet, self.columns, self.overwrite = options["path"], options.get("sheet", "Report"), columns, overwrite
        self.rows = min(int(options.get("rows", MAX_ROWS - 1)), MAX_ROWS - 1)
        self.run = uuid.uuid4().hex

    def _open(self):
        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        return store, root.rstrip("/"), f"{root.rstrip('/')}/_staged-{self.run}"

    def begin(self) -> _WorkbookWriter:
        """Makes the hidden folder: before the job, so that no late task makes it again."""
        store, _, staged = self._open()
        store.create_dir(staged)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _, staged = self._open()
        task, files = TaskContext.get(), []
        rows = (row for batch in iterator for row in zip(*[c.to_pylist() for c in batch.columns]))
        for first in rows:
            name = f"part-{task.partitionId():05d}-{len(files):03d}-{task.taskAttemptId()}.xlsx"
            with store.open_output_stream(f"{staged}/{name}") as out:
                _write_book(out, self.sheet, self.columns, chain([first], islice(rows, self.rows - 1)))
            files.append(name)
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root, staged = self._open()
        chosen = {f for m in messages if m for f in m.files}
        for info in store.get_file_info(fs.FileSelector(staged)):
            if info.base_name not in chosen:  # of an attempt that was lost or came second
                store.delete_file(info.path)
        if not chosen:
            with store.open_output_stream(f"{staged}/part-empty.xlsx") as out:
                _write_book(out, self.sheet, self.columns, ())
        before = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("run-")]
        store.move(staged, f"{root}/run-{self.run}")
        for path in before if self.overwrite else ():
            store.delete_dir(path)

    def abort(self, messages: list[_Written | None]) -> None:
        """Tasks that still run find their folder gone and end; what one of them
        adds in the meantime is removed by the next try."""
        store, _, staged = self._open()
        for wait in (0.1, 0.4, 1.6, 0):
            try:
                if store.get_file_info(staged).type != fs.FileType.NotFound:
                    store.delete_dir(staged)
                return
            except OSError:
                if not wait:
                    raise
                time.sleep(wait)


class Workbooks(DataSource):
    """Sink ``workbooks``: each task writes workbooks of at most ``rows`` rows
    into a hidden folder; the commit keeps the files of the attempts that
    counted and shows them all by one rename, an abort leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> _WorkbookWriter:
        return _WorkbookWriter(dict(self.options), schema.names, overwrite).begin()


def write_workbooks(df: DataFrame, path: str, sheet: str = "Report", rows: int = MAX_ROWS - 1, mode: str = "append") -> None:
    """``df`` as workbooks in a new folder ``run-*`` below ``path``, which all
    executors and the driver must reach by the same address (a shared mount, or
    one of pyarrow's file systems).  ``append`` adds a run, ``overwrite`` removes
    the earlier ones once the new one is shown.  Whole numbers and booleans stay what they
    are, null is an empty cell, anything else is text.  An empty table gives one
    workbook with a header alone."""
    df.sparkSession.dataSource.register(Workbooks)
    df.write.format("workbooks").mode(mode).option("sheet", sheet).option("rows", rows).save(path)
