"""Documents written by many tasks and shown all at once: KML, XLSX workbooks, indented JSON and Markdown.

Each task writes whole documents of a bounded number of rows into a staging folder below the target.  The driver's
commit moves them into place and writes the document that names them last (a KML of network links, else a manifest), so a
reader finds either nothing or all of it; if a task fails for good, the staging folder goes.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from terralith.sources.files import system_of

FORMAT = "terralith_documents"
#: Rows of one document, by kind (a sheet of a workbook ends at 1,048,576 rows, of which one is the head).
MOST_ROWS = {"kml": 50_000, "xlsx": 1_000_000, "json": 100_000, "md": 10_000}
_KML = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{}</name>\n'


def write(df: DataFrame, path: str, kind: str, name: str = "document", overwrite: bool = False, most_rows: int | None = None) -> None:
    """df as documents of a kind in the folder `path`: `kml` (one column, a placemark each: see sinks.placemark), `xlsx`,
    `json` or `md` (any columns).  Rows keep their order within a partition.  An empty df gives the naming document alone.
    A folder that has been committed already is an error, unless it is to be overwritten."""
    df.sparkSession.dataSource.register(CommittedDocuments)
    rows = df if kind == "kml" else df.select(*(df[f"`{c}`"] if simple(t) else to_text(df, c) for c, t in df.dtypes))
    options = {"path": qualified(df.sparkSession, path), "kind": kind, "name": name, "rows": str(most_rows or MOST_ROWS[kind])}
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").options(**options).save()


def simple(kind: str) -> bool:
    return kind in ("string", "int", "bigint", "smallint", "tinyint", "double", "float", "boolean")


def to_text(df: DataFrame, column: str):
    """Dates, decimals and the like as text, nested values as JSON."""
    from pyspark.sql import functions as F

    kind = dict(df.dtypes)[column]
    value = df[f"`{column}`"]
    return (F.to_json(value) if kind.startswith(("array", "map", "struct")) else value.cast("string")).alias(column)


def qualified(spark: SparkSession, path: str) -> str:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]
    rows: int


class CommittedDocuments(DataSource):
    """The write side of the format (options path, kind, name, rows)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(schema, dict(self.options), overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.columns, self.uri, self.kind, self.title = schema.names, options["path"].rstrip("/"), options["kind"], options["name"]
        self.most, self.overwrite, self.job = int(options["rows"]), overwrite, uuid.uuid4().hex
        if self.kind not in MOST_ROWS:
            raise ValueError(f"kind {self.kind}: none of {sorted(MOST_ROWS)}")
        if not overwrite and _exists(f"{self.uri}/{self.index_name}"):
            raise ValueError(f"{self.uri} holds documents already")

    @property
    def index_name(self) -> str:
        return "doc.kml" if self.kind == "kml" else "manifest.json"

    @property
    def staging(self) -> str:
        return f"{self.uri}/_staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        """A task's documents.  Each attempt has names of its own; the driver hears of one attempt's only."""
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        system, folder = system_of(self.staging)
        system.create_dir(folder, recursive=True)
        files, total, rows = [], 0, iter(rows)
        while (first := next(rows, None)) is not None:
            file = f"part-{task:05d}-{len(files):05d}-{attempt}.{self.kind}"
            with system.open_output_stream(f"{folder}/{file}") as out:
                total += _WRITERS[self.kind](out, self.columns, first, islice(rows, self.most - 1), self.title)
            files.append(file)
        return Written(tuple(files), total)

    def commit(self, messages: list[Written | None]) -> None:
        system, target = system_of(self.uri)
        files = sorted(f for m in messages if m for f in m.files)
        system.create_dir(target, recursive=True)
        if self.overwrite:  # readers see nothing between the old documents and the new ones
            for info in system.get_file_info(fs.FileSelector(target)):
                if info.base_name == self.index_name or info.base_name.startswith("part-"):
                    system.delete_file(info.path)
        for file in files:
            system.move(f"{target}/_staging-{self.job}/{file}", f"{target}/{file}")
        index = _links(self.title, files) if self.kind == "kml" else json.dumps({"name": self.title, "rows": sum(m.rows for m in messages if m), "files": files}, indent=2, ensure_ascii=False)
        with system.open_output_stream(f"{target}/{self.index_name}") as out:
            out.write(index.encode())
        self._drop(system, target)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*system_of(self.uri))

    def _drop(self, system: fs.FileSystem, target: str) -> None:
        if system.get_file_info(f"{target}/_staging-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{target}/_staging-{self.job}")


def _exists(uri: str) -> bool:
    system, path = system_of(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def _links(name: str, files: list[str]) -> str:
    links = "".join(f"<NetworkLink><name>{escape(f)}</name><Link><href>{escape(f)}</href></Link></NetworkLink>\n" for f in files)
    return _KML.format(escape(name)) + links + "</Document></kml>\n"


def _kml(out: io.IOBase, columns: list[str], first: Row, rows: Iterator[Row], title: str) -> int:
    out.write(_KML.format(escape(title)).encode())
    n = 0
    for row in _chain(first, rows):
        if row[0] is not None:
            out.write(f"{row[0]}\n".encode())
            n += 1
    out.write(b"</Document></kml>\n")
    return n


def _json(out: io.IOBase, columns: list[str], first: Row, rows: Iterator[Row], title: str) -> int:
    """{"name": ..., "rows": [...]}, indented; a value that JSON lacks (NaN) is null."""
    out.write(f'{{\n  "name": {json.dumps(title, ensure_ascii=False)},\n  "rows": ['.encode())
    n = 0
    for n, row in enumerate(_chain(first, rows), 1):
        held = {c: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v for c, v in zip(columns, row)}
        text = json.dumps(held, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        out.write((("," if n > 1 else "") + "\n    " + text).encode())
    out.write(b"\n  ]\n}\n")
    return n


def _md(out: io.IOBase, columns: list[str], first: Row, rows: Iterator[Row], title: str) -> int:
    """A heading and a table; bars and line ends inside values are escaped."""
    plain = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\r", "").replace("\n", "<br>")
    line = lambda values: ("| " + " | ".join(map(plain, values)) + " |\n").encode()
    out.write(f"# {title}\n\n".encode() + line(columns) + ("|" + " --- |" * len(columns) + "\n").encode())
    n = 0
    for n, row in enumerate(_chain(first, rows), 1):
        out.write(line(row))
    return n


#: The parts of a workbook with one sheet (fixed values of the format).
_BOOK = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def column_letters(n: int) -> str:
    """A, B, ..., Z, AA, ... for 1, 2, ..."""
    out = ""
    while n:
        n, digit = divmod(n - 1, 26)
        out = chr(ord("A") + digit) + out
    return out


def _cell(letters: str, row: int, value) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{letters}{row}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and value not in (float("inf"), float("-inf")):
        return f'<c r="{letters}{row}"><v>{value!r}</v></c>'
    clean = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _xlsx(out: io.IOBase, columns: list[str], first: Row, rows: Iterator[Row], title: str) -> int:
    """A workbook of one sheet, its head in the first row; texts stand in their cells, so nothing is held."""
    letters = [column_letters(i + 1) for i in range(len(columns))]
    sheet = "".join(c for c in title if c not in "[]:*?/\\")[:31] or "rows"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _BOOK.items():
            z.writestr(name, text)
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            part.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            n = 0
            for n, row in enumerate(_chain(columns, _chain(first, rows)), 1):
                part.write(f'<row r="{n}">{"".join(_cell(c, n, v) for c, v in zip(letters, row))}</row>'.encode())
            part.write(b"</sheetData></worksheet>")
    return n - 1


def _chain(first, rest: Iterator):
    yield first
    yield from rest


_WRITERS = {"kml": _kml, "xlsx": _xlsx, "json": _json, "md": _md}
