"""Geometries as nested arrays of numbers: parsing of coordinate text, validity, dimension, GeoJSON and KML.

A whole geometry, of any kind, is a column of type GEOMETRY: its type and its parts, each a Point, LineString or Polygon
with rings of points [lon, lat] or [lon, lat, altitude].  A point or line has one ring; a polygon's first is the outer one
and the others are holes.  Collections in collections are one list of parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of geometry types (fixed values).
LABELS = {"Point": "Point", "LineString": "Ligne", "MultiLineString": "Ligne", "Polygon": "Polygone", "MultiPolygon": "MultiPolygone"}


#: Column type of a whole geometry.
GEOMETRY = "struct<type:string,parts:array<struct<type:string,rings:array<array<array<double>>>>>>"
SINGLE = ("Point", "LineString", "Polygon")


def parse_coordinates(text: Column) -> Column:
    """'lon,lat[,alt] lon,lat ...' as an array of arrays; parts that are no numbers are left out."""
    points = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    numbers = F.transform(points, lambda p: F.array_compact(F.transform(F.split(p, ","), lambda n: n.try_cast("double"))))
    return F.filter(numbers, lambda p: F.size(p) >= 2)


def flat(points: Column) -> Column:
    """Points without altitude."""
    return F.transform(points, lambda p: F.slice(p, 1, 2))


def ring_closed(points: Column) -> Column:
    """At least four points, the last on the first."""
    return (F.size(points) >= 4) & (F.slice(F.element_at(points, 1), 1, 2) == F.slice(F.element_at(points, -1), 1, 2))


def valid_lon_lat(lon: Column, lat: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def representative(points: Column) -> Column:
    """First point, or null."""
    return F.try_element_at(points, F.lit(1))


def label(kind: Column) -> Column:
    out = None
    for name, text in LABELS.items():
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise("Inconnue")


def point_feature(lon: Column, lat: Column, **properties: Column) -> Column:
    """GeoJSON text of a feature; no geometry where a coordinate is missing."""
    geometry = F.when(lon.isNotNull() & lat.isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*(v.alias(k) for k, v in properties.items())).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


# --- whole geometries ------------------------------------------------------------------------------------


def part(kind: str, rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), rings.alias("rings"))


def whole(parts: Column) -> Column:
    """Parts as a geometry: one is itself, several of one kind are Multi..., others a GeometryCollection; null if there is
    none."""
    first = F.try_element_at(parts, F.lit(1))["type"]
    alike = F.forall(parts, lambda p: p["type"] == first)
    kind = F.when(F.size(parts) == 1, first).when(alike, F.concat(F.lit("Multi"), first)).otherwise("GeometryCollection")
    return F.when(F.size(parts) > 0, F.struct(kind.alias("type"), parts.alias("parts")))


def _coordinates(kind: Column, parts: Column) -> Column:
    """JSON text of the coordinates of parts of one kind."""
    point = lambda p: p["rings"][0][0]
    line = lambda p: p["rings"][0]
    return (
        F.when(kind == "Point", F.to_json(point(parts[0]))).when(kind == "LineString", F.to_json(line(parts[0]))).when(kind == "Polygon", F.to_json(parts[0]["rings"]))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, point))).when(kind == "MultiLineString", F.to_json(F.transform(parts, line)))
        .when(kind == "MultiPolygon", F.to_json(F.transform(parts, lambda p: p["rings"])))
    )


def _object(kind: Column, coordinates: Column) -> Column:
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))


def geojson(geometry: Column) -> Column:
    """GeoJSON text of a whole geometry; null stays null."""
    parts = geometry["parts"]
    each = F.transform(parts, lambda p: _object(p["type"], _coordinates(p["type"], F.array(p))))
    several = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(each, ","), F.lit("]}"))
    return F.when(geometry["type"] == "GeometryCollection", several).otherwise(_object(geometry["type"], _coordinates(geometry["type"], parts)))


def _parts(kind: Column, text: Column) -> Column:
    """Parts of a GeoJSON object that has coordinates, given as their JSON text; none for other kinds."""
    read = lambda name, depth: F.from_json(F.when(kind == name, text), "array<" * depth + "double" + ">" * depth)
    point, points, line, lines = read("Point", 1), read("MultiPoint", 2), read("LineString", 2), read("MultiLineString", 3)
    polygon, polygons = read("Polygon", 3), read("MultiPolygon", 4)
    empty = F.from_json(F.lit("[]"), "array<struct<type:string,rings:array<array<array<double>>>>>")
    found = F.coalesce(
        F.when(F.size(point) >= 2, F.array(part("Point", F.array(F.array(point))))),
        F.transform(points, lambda p: part("Point", F.array(F.array(p)))),
        F.when(F.size(line) > 0, F.array(part("LineString", F.array(line)))),
        F.transform(lines, lambda x: part("LineString", F.array(x))),
        F.when(F.size(polygon) > 0, F.array(part("Polygon", polygon))),
        F.transform(polygons, lambda x: part("Polygon", x)),
    )
    return F.coalesce(found, empty)


def from_geojson(text: Column) -> Column:
    """A whole geometry from GeoJSON text (a collection's members may not be collections); null for what is none.  A
    Multi... of one member becomes that member."""
    top = F.from_json(text, "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>")
    members = F.flatten(F.transform(top["geometries"], lambda g: _parts(g["type"], g["coordinates"])))
    return whole(F.when(top["type"] == "GeometryCollection", F.coalesce(members, F.array().cast("array<struct<type:string,rings:array<array<array<double>>>>>"))).otherwise(_parts(top["type"], top["coordinates"])))


def first_point(geometry: Column) -> Column:
    """(lat, lon, alt) of the first coordinate, whatever the kind; a collection has no coordinates of its own, and so
    none of its points stands for it."""
    p = F.when(geometry["type"] != "GeometryCollection", geometry["parts"][0]["rings"][0][0])
    return F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon"), F.get(p, 2).alias("alt"))


def _kml_points(points: Column) -> Column:
    return F.concat(F.lit("<coordinates>"), F.array_join(F.transform(points, lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), " "), F.lit("</coordinates>"))


def _kml_part(p: Column) -> Column:
    ring = lambda r: F.concat(F.lit("<LinearRing>"), _kml_points(r), F.lit("</LinearRing>"))
    holes = F.transform(F.slice(p["rings"], F.lit(2), F.size(p["rings"])), lambda r: F.concat(F.lit("<innerBoundaryIs>"), ring(r), F.lit("</innerBoundaryIs>")))
    polygon = F.concat(F.lit("<Polygon><outerBoundaryIs>"), ring(p["rings"][0]), F.lit("</outerBoundaryIs>"), F.array_join(holes, ""), F.lit("</Polygon>"))
    tag = lambda name: F.concat(F.lit(f"<{name}>"), _kml_points(p["rings"][0]), F.lit(f"</{name}>"))
    return F.when(p["type"] == "Point", tag("Point")).when(p["type"] == "LineString", tag("LineString")).otherwise(polygon)


def kml(geometry: Column) -> Column:
    """A whole geometry as a KML element; null is the empty text."""
    each = F.array_join(F.transform(geometry["parts"], _kml_part), "")
    return F.coalesce(F.when(F.size(geometry["parts"]) > 1, F.concat(F.lit("<MultiGeometry>"), each, F.lit("</MultiGeometry>"))).otherwise(each), F.lit(""))


def feature(geometry: Column, **properties: Column) -> Column:
    """GeoJSON text of a feature with a whole geometry, null geometry included; null properties are written as null."""
    held = F.to_json(F.struct(*(v.alias(k) for k, v in properties.items())), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","properties":'), held, F.lit(',"geometry":'), F.coalesce(geojson(geometry), F.lit("null")), F.lit("}"))


def layer(rows, geometry: str, **properties: Column):
    """The map layer of an entity table: a feature for each row that has a geometry (a column of type GEOMETRY)."""
    return rows.filter(F.col(geometry).isNotNull()).select(*rows.columns, feature(F.col(geometry), **properties).alias("feature"))
