"""KML and KMZ files as one row a placemark.

Documents are parsed as they are read, event by event: a placemark becomes a row and is let go, so a task holds one
placemark and the folders above it, whatever the size of the document.  A folder's name comes before what lies in it, as
the schema of the format has it.  Everything after that is columns.
"""

from __future__ import annotations

import contextlib
import io
import itertools
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators.geometry import GEOMETRY
from terralith.sources.files import STREAMED, documents, member, opened, xml_events

SCHEMA = (
    "file string, ord long, path array<string>, name string, description string, style_url string, "
    "ext array<struct<k:string,v:string>>, geometry_type string, coordinates string, error string"
)

GEOMETRY_SCHEMA = "file string, ord long, geometry_type string, geometry string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _child_text(node, name: str) -> str | None:
    return next(((c.text or "").strip() for c in node if _local(c.tag) == name), None)


def features(stream: io.IOBase, also: str = "") -> Iterator[tuple[list[str], ElementTree.Element]]:
    """(folder path, element) of every placemark of a KML document, or of the one in a KMZ (its first .kml member), in
    document order; and of every other element with the tag `also`.  The element is valid until the next one."""
    names: list[str] = []
    open_: list[ElementTree.Element] = []  # elements that are begun
    inside = 0  # how many of them are placemarks or `also`
    with member(stream, ".kml") as (_, document):
        for event, node in xml_events(document):
            kind = _local(node.tag)
            if event == "start":
                open_.append(node)
                if kind in ("Document", "Folder") and not inside:
                    names.append("")
                inside += kind in ("Placemark", also)
                continue
            open_.pop()
            parent = open_[-1] if open_ else None
            if kind in ("Placemark", also):
                inside -= 1
                if not inside:
                    yield [n for n in names if n], node
            elif kind in ("Document", "Folder") and not inside:
                names.pop()
            elif kind == "name" and parent is not None and _local(parent.tag) in ("Document", "Folder") and not inside:
                names[-1] = names[-1] or (node.text or "").strip()
            if not inside and parent is not None:
                parent.remove(node)


def _extended(placemark) -> list[dict]:
    out: dict[str, str] = {}
    for kind in ("Data", "SimpleData"):
        for node in placemark.iter():
            if _local(node.tag) == kind and node.get("name"):
                value = _child_text(node, "value") if kind == "Data" else (node.text or "").strip()
                out[node.get("name").strip()] = value or ""
    return [{"k": k, "v": v} for k, v in out.items()]


def _points(text: str | None) -> list[list[float]]:
    out = []
    for chunk in (text or "").split():
        try:
            p = [float(x) for x in chunk.split(",") if x != ""]
        except ValueError:
            continue
        if len(p) >= 2:
            out.append(p)
    return out


def _geometry(placemark) -> tuple[str | None, str | None]:
    """Polygons before points before lines; several polygons are one MultiPolygon.  Outer rings only."""
    found: dict[str, list] = {"Polygon": [], "Point": [], "LineString": []}
    for node in placemark.iter():
        kind = _local(node.tag)
        if kind in found:
            ring = next((c for c in node.iter() if _local(c.tag) == "coordinates"), None)
            points = _points(None if ring is None else ring.text)
            if points:
                found[kind].append(points)
    if len(found["Polygon"]) > 1:
        return "MultiPolygon", json.dumps([[p] for p in found["Polygon"]])
    if found["Polygon"]:
        return "Polygon", json.dumps([found["Polygon"][0]])
    if found["Point"]:
        return "Point", json.dumps(found["Point"][0][0])
    if found["LineString"]:
        return "LineString", json.dumps(found["LineString"][0])
    return None, None


def _geojson(node) -> dict | None:
    """A geometry element as GeoJSON: points with their altitude, others without, of polygons the outer ring; several in
    one element are a GeometryCollection of those that have coordinates."""
    kind = _local(node.tag)
    if kind == "MultiGeometry":
        parts = [g for g in map(_geojson, node) if g]
        return {"type": "GeometryCollection", "geometries": parts} if parts else None
    ring = next((c for c in node.iter() if _local(c.tag) == "coordinates"), None)
    points = _points(None if ring is None else ring.text)
    if not points or kind not in ("Point", "LineString", "Polygon"):
        return None
    if kind == "Point":
        return {"type": kind, "coordinates": points[0][:3]}
    flat = [p[:2] for p in points]
    return {"type": kind, "coordinates": [flat] if kind == "Polygon" else flat}


#: Rows of a frame that goes from a task to Spark.
FRAME = 1000
_UNREADABLE = (ValueError, ElementTree.ParseError, zipfile.BadZipFile)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(itertools.islice(rows, FRAME)):
        out = pd.DataFrame(part, columns=columns).astype(object)
        yield out.where(out.notna(), None)


def placemarks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content) of documents as rows of SCHEMA (see files.opened for content)."""

    def rows(file: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with opened(file, content) as stream:
                for i, (p, m) in enumerate(features(stream)):
                    yield file, i, p, _child_text(m, "name"), _child_text(m, "description"), _child_text(m, "styleUrl"), _extended(m), *_geometry(m), None
        except _UNREADABLE as e:
            yield file, None, [], None, None, None, [], None, None, str(e)

    columns = ["file", "ord", "path", "name", "description", "style_url", "ext", "geometry_type", "coordinates", "error"]
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            yield from _frames(rows(file, content), columns)


def read_placemarks(spark: SparkSession, path: str, streamed: int = STREAMED) -> DataFrame:
    """One row a placemark in document order.  A file that can't be read gives a row with `error` and no `ord`, after the
    placemarks that stand before the fault."""
    return documents(spark, path, streamed).mapInPandas(placemarks, SCHEMA)


def geometries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content) of documents as one row a placemark with a geometry: the first of its Point, LineString, Polygon
    and MultiGeometry elements.  What stands after a fault in a document gives none (read_placemarks tells why)."""

    def rows(file: str, content: bytes | None) -> Iterator[tuple]:
        with contextlib.suppress(*_UNREADABLE), opened(file, content) as stream:
            for i, (_, mark) in enumerate(features(stream)):
                nodes = [c for kind in ("Point", "LineString", "Polygon", "MultiGeometry") for c in mark if _local(c.tag) == kind]
                found = next((g for g in map(_geojson, nodes) if g), None)
                if found:
                    yield file, i, found["type"], json.dumps(found, separators=(",", ":"))

    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            yield from _frames(rows(file, content), ["file", "ord", "geometry_type", "geometry"])


def read_geometries(spark: SparkSession, path: str, streamed: int = STREAMED) -> DataFrame:
    """Geometries as GeoJSON text; (file, ord) are those of read_placemarks."""
    return documents(spark, path, streamed).mapInPandas(geometries, GEOMETRY_SCHEMA)


def _shape(node) -> list[dict]:
    """Parts (see operators.geometry) of a geometry element: holes and altitudes are kept, parts without coordinates
    aren't."""
    kind = _local(node.tag)
    if kind == "MultiGeometry":
        return [p for child in node for p in _shape(child)]
    if kind not in ("Point", "LineString", "Polygon"):
        return []
    if kind == "Polygon":
        rings = [_points(c.text) for side in ("outerBoundaryIs", "innerBoundaryIs") for b in node if _local(b.tag) == side for c in b.iter() if _local(c.tag) == "coordinates"]
    else:
        rings = [_points(c.text) for c in node if _local(c.tag) == "coordinates"]
        rings = [r[:1] if kind == "Point" else r for r in rings[:1]]
    return [{"type": kind, "rings": [[p[:3] for p in r] for r in rings if r]}] if rings and rings[0] else []


def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content) of documents as one row a placemark with its whole geometry: all its geometry elements."""

    def rows(file: str, content: bytes | None) -> Iterator[tuple]:
        with contextlib.suppress(*_UNREADABLE), opened(file, content) as stream:
            for i, (_, mark) in enumerate(features(stream)):
                parts = [p for node in mark for p in _shape(node)]
                if parts:
                    kinds = {p["type"] for p in parts}
                    kind = "GeometryCollection" if len(kinds) > 1 else ("Multi" if len(parts) > 1 else "") + kinds.pop()
                    yield file, i, {"type": kind, "parts": parts}

    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            yield from _frames(rows(file, content), ["file", "ord", "geometry"])


SHAPE_SCHEMA = f"file string, ord long, geometry {GEOMETRY}"


def read_shapes(spark: SparkSession, path: str, streamed: int = STREAMED) -> DataFrame:
    """Whole geometries of placemarks; (file, ord) are those of read_placemarks."""
    return documents(spark, path, streamed).mapInPandas(shapes, SHAPE_SCHEMA)


def extended_map(ext: Column) -> Column:
    return F.map_from_entries(F.transform(ext, lambda e: F.struct(e["k"], e["v"])))


def innermost_folder(path: Column, default: str = "Racine") -> Column:
    return F.coalesce(F.try_element_at(F.filter(path, lambda x: x != ""), F.lit(-1)), F.lit(default))


def zone_of_path(path: Column) -> Column:
    """First path element that starts with 'zone '."""
    return F.try_element_at(F.filter(path, lambda x: F.lower(x).startswith("zone ")), F.lit(1))


def province_after_marker(path: Column) -> Column:
    """The element after 'provinces'."""
    at = F.array_position(F.transform(path, lambda x: F.lower(x)), "provinces")
    return F.when(at > 0, F.try_element_at(path, (at + 1).cast("int")))


def province_of_collectivities(path: Column) -> Column:
    """What follows 'Collectivités ' in the innermost element that starts so."""
    hit = F.try_element_at(F.filter(F.reverse(path), lambda x: F.translate(F.lower(x), "é", "e").startswith("collectivites ")), F.lit(1))
    return F.trim(F.regexp_replace(hit, "(?i)^collectivit[ée]s ", ""))


def resolved_styles(spark: SparkSession, path: str) -> DataFrame:
    """(file, style_id, line_color, poly_color) of shared styles, for joins on style_url; files that can't be
    read have none (read_placemarks tells why)."""

    def rows(file: str, content: bytes | None) -> Iterator[tuple]:
        with contextlib.suppress(*_UNREADABLE), opened(file, content) as stream:
            for _, mark in features(stream, also="Style"):
                for node in mark.iter():
                    if _local(node.tag) == "Style" and node.get("id"):
                        colors = {_local(s.tag): _child_text(s, "color") for s in node}
                        yield file, f"#{node.get('id')}", colors.get("LineStyle"), colors.get("PolyStyle")

    def styles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                yield from _frames(rows(file, content), ["file", "style_id", "line_color", "poly_color"])

    return documents(spark, path).mapInPandas(styles, "file string, style_id string, line_color string, poly_color string")
