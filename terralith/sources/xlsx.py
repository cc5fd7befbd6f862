"""XLSX workbooks as one row a non-empty cell, with the standard library only; tables are pivoted from cells."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators.windows import carry_forward
from terralith.sources.files import STREAMED, documents, opened, xml_events

SCHEMA = "file string, sheet_ord int, sheet string, row int, col string, value string"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _rows_of(stream: io.IOBase, tag: str) -> Iterator[ElementTree.Element]:
    """The elements with this tag of an XML stream, one at a time; what is read is let go."""
    open_: list[ElementTree.Element] = []
    inside = 0
    for event, node in xml_events(stream):
        wanted = _local(node.tag) == tag
        if event == "start":
            open_.append(node)
            inside += wanted
            continue
        open_.pop()
        inside -= wanted
        if not inside:
            if wanted:
                yield node
            if open_:
                open_[-1].remove(node)


def workbook_cells(stream: io.IOBase | bytes) -> Iterator[tuple[int, str, int, str, str]]:
    """(sheet number, sheet, row, column, value) of every filled cell.  Sheets are parsed as they are read; a workbook's
    shared strings are held, as its cells name them by number."""
    with zipfile.ZipFile(io.BytesIO(stream) if isinstance(stream, bytes) else stream) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = [_texts(n) for n in _rows_of(part, "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]
        for i, sheet in enumerate(sheets):
            name = "xl/" + targets[sheet.get(_REL)].removeprefix("/xl/").lstrip("/")
            with z.open(name) as part:
                for cell in _rows_of(part, "c"):
                    raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
                    kind = cell.get("t")
                    value = shared[int(raw)] if kind == "s" and raw is not None else _texts(cell) if kind == "inlineStr" else raw
                    place = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
                    if value is not None and place:
                        yield i, sheet.get("name"), int(place[2]), place[1], value


#: Cells of a frame that goes from a task to Spark.
FRAME = 10_000


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            with opened(file, content) as stream:
                cells = workbook_cells(stream)
                while part := list(itertools.islice(cells, FRAME)):
                    yield pd.DataFrame([(file, *c) for c in part], columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"sheet": object, "col": object, "value": object, "file": object})


def read_cells(spark: SparkSession, path: str, streamed: int = STREAMED) -> DataFrame:
    return documents(spark, path, streamed).mapInPandas(_cells, SCHEMA)


def read_table(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None, header_rows: int = 1) -> DataFrame:
    """Rows of the sheets (or one of them) with the given columns {letter: name}; row numbers stay, blank is null."""
    cells = read_cells(spark, path).filter(F.col("row") > header_rows)
    cells = cells if sheet is None else cells.filter(F.col("sheet") == sheet)
    wide = cells.groupBy("file", "sheet_ord", "sheet", "row").pivot("col", list(columns)).agg(F.first("value"))
    return wide.select("file", "sheet_ord", "sheet", "row", *(F.nullif(F.trim(F.col(k)), F.lit("")).alias(v) for k, v in columns.items()))


def header_rows(cells: DataFrame, known: list[str], least: int = 3) -> DataFrame:
    """(file, sheet, row) of each sheet's first row in which at least `least` known headers occur."""
    upper = F.upper(F.trim(F.regexp_replace("value", r"\s+", " ")))
    hits = cells.filter(upper.isin(known)).groupBy("file", "sheet", "row").agg(F.countDistinct(upper).alias("n")).filter(F.col("n") >= least)
    return hits.groupBy("file", "sheet").agg(F.min("row").alias("row"))


def workbook_entities(cells: DataFrame) -> DataFrame:
    """Zones, provinces and towns or territories of the official workbook's cells (file, sheet_ord, sheet, row, col,
    value): a sheet is a zone, its code the last word; column C names a province, which holds for the rows
    below; E names what lies in it, G is its code and I its number of sites.  A sheet is at most a million rows, so a
    window over a sheet is bounded."""
    wide = cells.groupBy("file", "sheet_ord", "sheet", "row").pivot("col", ["B", "C", "E", "G", "I"]).agg(F.first("value"))
    text = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("B", "C", "E", "G", "I")}
    rows = wide.select("file", "sheet_ord", "sheet", "row", *(v.alias(c) for c, v in text.items())).withColumn("zone_code", sheet_zone(F.col("sheet")))
    province = F.when(F.upper("C") != "PROVINCE", F.struct(F.col("C").alias("name"), F.coalesce("B", "G", "C").alias("code")))
    rows = carry_forward(rows.withColumn("_own", province), F.col("_own"), "_province", ["file", "sheet_ord"], ["row"])
    kind = F.when(F.contains(F.upper("E"), F.lit("VILLE")), "ville").otherwise("territoire")
    none = F.lit(None).cast("string")
    sheets = cells.select("file", "sheet", F.lit(0).alias("row"), sheet_zone(F.col("sheet")).alias("zone_code")).distinct()
    zones = sheets.select("file", "sheet", "row", F.lit("zone").alias("level"), F.col("sheet").alias("raw_name"), F.col("zone_code").alias("raw_code"), none.alias("parent_code"), "zone_code", none.alias("province_name"), none.alias("territory_name"), none.alias("sites"))
    provinces = rows.filter("_own IS NOT NULL").select("file", "sheet", "row", F.lit("province").alias("level"), F.col("_own.name").alias("raw_name"), F.col("_own.code").alias("raw_code"), F.col("zone_code").alias("parent_code"), "zone_code", F.col("_own.name").alias("province_name"), none.alias("territory_name"), F.col("I").alias("sites"))
    local = rows.filter(F.upper("E") != "TOWN/TERRITORY").withColumn("_kind", kind)
    local = local.select("file", "sheet", "row", F.col("_kind").alias("level"), F.col("E").alias("raw_name"), F.col("G").alias("raw_code"), F.coalesce("_province.code", "zone_code").alias("parent_code"), "zone_code", F.col("_province.name").alias("province_name"), F.when(F.col("_kind") == "territoire", F.col("E")).alias("territory_name"), F.col("I").alias("sites"))
    return zones.unionByName(provinces).unionByName(local)


def sheet_zone(sheet: Column) -> Column:
    """The last word of the sheet's name, in capitals."""
    return F.upper(F.element_at(F.split(F.trim(sheet), r"\s+"), -1))
