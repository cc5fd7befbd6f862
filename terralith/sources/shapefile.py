"""Shapefiles: attribute tables (.dbf) from their fixed-width records, shapes (.shp) as GeoJSON."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, ord long, properties map<string,string>"


def dbf_records(data: bytes) -> list[tuple[int, dict[str, str]]]:
    """(number of the record, its fields) of the records that aren't deleted."""
    count, header, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at : at + 1] not in (b"\r", b""):
        fields.append((data[at : at + 11].split(b"\0", 1)[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    rows = []
    for i in range(count):
        record, place, row = data[header + i * width : header + (i + 1) * width], 1, {}
        if record[:1] == b"*":
            continue
        for name, size in fields:
            row[name] = record[place : place + size].decode("utf-8", "replace").strip()
            place += size
        rows.append((i, row))
    return rows


def dbf_rows(data: bytes) -> list[dict[str, str]]:
    return [row for _, row in dbf_records(data)]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            rows = [(file, i, r) for i, r in dbf_records(bytes(content))]
            yield pd.DataFrame(rows, columns=["file", "ord", "properties"]).astype({"file": object, "properties": object})


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    path = path[:-4] + ".dbf" if path.lower().endswith(".shp") else path
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, SCHEMA)


def _area(ring: list[list[float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _shape(body: bytes) -> dict | None:
    """A record's shape as GeoJSON, x and y only.  Clockwise rings are outer ones, others are holes of the ring before
    them, as writers of the format order them."""
    kind = struct.unpack_from("<i", body)[0] % 10
    if kind == 1:
        return {"type": "Point", "coordinates": list(struct.unpack_from("<2d", body, 4))}
    if kind == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        flat = struct.unpack_from(f"<{2 * n}d", body, 40)
        return {"type": "MultiPoint", "coordinates": [list(p) for p in zip(flat[::2], flat[1::2])]}
    if kind not in (3, 5):
        return None
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
    points = [list(p) for p in zip(flat[::2], flat[1::2])]
    lines = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind == 3:
        return {"type": "LineString", "coordinates": lines[0]} if parts == 1 else {"type": "MultiLineString", "coordinates": lines}
    polygons: list[list] = []
    for ring in lines:
        if polygons and _area(ring) > 0:
            polygons[-1].append(ring)
        else:
            polygons.append([ring])
    return {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons}


def shapes(data: bytes) -> list[tuple[int, str, str]]:
    """(number of the record, geometry type, GeoJSON) of the records of a .shp file; null shapes have no row."""
    at, out = 100, []
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        found = _shape(data[at + 8 : at + 8 + 2 * words])
        if found:
            out.append((number - 1, found["type"], json.dumps(found)))
        at += 8 + 2 * words
    return out


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, geometry_type, geometry) of .shp files; ord is that of read_attributes for the same name."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = [(file, *r) for r in shapes(bytes(content))]
                yield pd.DataFrame(rows, columns=["file", "ord", "geometry_type", "geometry"]).astype({"file": object, "ord": "int64", "geometry_type": object, "geometry": object})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, ord long, geometry_type string, geometry string")
