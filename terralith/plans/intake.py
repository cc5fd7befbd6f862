"""Queries of import previews, structure sheets, children by layer and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators import geometry as g
from terralith.operators import intake as i
from terralith.plans.audits import _ISSUES_SQL, prepared_customers
from terralith.plans.tables import read
from terralith.scratch import folder
from terralith.sources import committed, geojson, kml, xlsx
from terralith.sources.sinks import placemark, shape_placemark

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""WITH l AS (SELECT 'o_orderstatus' AS field, o_orderkey AS o, trim(o_orderstatus) AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderkey, trim(o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders),
v AS (SELECT field, value, min(o) AS f FROM l WHERE value <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY f, value) AS k FROM v)
SELECT field, string_agg(value, '|' ORDER BY k) AS examples FROM r WHERE k <= 3 GROUP BY field UNION ALL SELECT 'vide', ''""")
def attribute_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first three values of several columns, one of them always blank."""
    rows = read(spark, d, "orders").withColumn("vide", F.lit(" "))
    found = i.value_preview(rows, "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey", "vide"])
    return found.select("field", F.array_join("examples", "|").alias("examples"))


@query("""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS r, CASE WHEN c_custkey % 11 > 0 THEN 'Site ' || CAST(c_custkey % 400 AS VARCHAR) END AS nom, CASE WHEN c_custkey % 11 > 0 AND c_custkey % 5 > 0 THEN c_mktsegment END AS province,
  CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 120 END AS lat, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 200 END AS lon FROM customer),
k AS (SELECT *, min(r) OVER (PARTITION BY nom, province) AS f FROM t WHERE nom IS NOT NULL)
SELECT 'colonnes_manquantes' AS type, CAST(NULL AS BIGINT) AS row, 'Colonne manquante probable : Territoire.' AS message
UNION ALL SELECT 'doublons_probables', r, 'Doublon probable ligne ' || CAST(r AS VARCHAR) || ' avec ligne ' || CAST(f AS VARCHAR) || ' : ' || nom || '.' FROM k WHERE r > f
UNION ALL SELECT 'coordonnees_invalides', r, 'Coordonnées invalides ligne ' || CAST(r AS VARCHAR) || '.' FROM k WHERE (lat IS NOT NULL OR lon IS NOT NULL) AND NOT coalesce(lat <= 90 AND lon <= 180, false)
UNION ALL SELECT 'sans_rattachement', r, 'Entité sans rattachement ligne ' || CAST(r AS VARCHAR) || '.' FROM k WHERE province IS NULL""")
def import_preview_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a file that lacks the territory's column."""
    key = F.col("c_custkey")
    name = F.when(key % 11 > 0, F.concat(F.lit("Site "), (key % 400).cast("string")))
    rows = read(spark, d, "customer").select(key.alias("ligne"), name.alias("NOM"), F.when((key % 11 > 0) & (key % 5 > 0), F.col("c_mktsegment")).otherwise(" ").alias("PROV"), F.when(key % 7 > 0, key % 120).alias("LAT"), F.when(key % 3 > 0, key % 200).alias("LON"))
    return i.import_anomalies(rows, {"nom": "NOM", "province": "PROV", "latitude": "LAT", "longitude": "LON"}, "ligne")


@query("""SELECT n_name AS parent, 'groupements' AS layer, s_name AS child FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 > 0
UNION ALL SELECT n_name, 'villages', c_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def children_by_layer(spark: SparkSession, d: str) -> DataFrame:
    """Groupings and villages of every territory; some groupings name none, and one layer isn't there."""
    nation = read(spark, d, "nation")
    near = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("nom"), F.when(F.col("s_suppkey") % 4 > 0, F.col("n_name")).otherwise("").alias("territoire"))
    far = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("nom"), F.col("n_name").alias("territoire"))
    return i.children_by_layer("territoires", nation.select(F.col("n_name").alias("nom")), {"groupements": near, "villages": far})


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as structure sheets, a sheet a region: a title, a row for each nation, then its suppliers, every tenth
    of them twice; one nation has no code, so its suppliers follow the nation before it."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("sheet_ord"), F.concat(F.lit("Z"), F.col("n_regionkey").cast("string")).alias("zone"))
    none = F.lit(None).cast("string")
    code = F.when(F.col("n_nationkey") % 12 != 7, F.concat(F.lit("P"), F.col("n_nationkey").cast("string"))).otherwise("")
    first = F.col("n_nationkey") * 1000000
    titles = nation.select("sheet_ord", "zone").distinct().select("sheet_ord", F.lit(-1).cast("long").alias("row"), "zone", F.col("zone").alias("province_code"), none.alias("province_name"), none.alias("territory_code"), none.alias("territory_name"), F.lit(None).cast("long").alias("sites"))
    heads = nation.select("sheet_ord", first.cast("long").alias("row"), "zone", code.alias("province_code"), F.col("n_name").alias("province_name"), none.alias("territory_code"), none.alias("territory_name"), F.lit(None).cast("long").alias("sites"))
    joined = nation.join(read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    times = F.explode(F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_turn")
    joined = joined.select("*", times)
    towns = joined.select("sheet_ord", (first + 2 * F.col("s_suppkey") + 1 + F.col("_turn")).cast("long").alias("row"), "zone", none.alias("province_code"), none.alias("province_name"), F.col("s_suppkey").cast("string").alias("territory_code"), F.col("s_name").alias("territory_name"), (F.col("s_suppkey") % 9 + F.col("_turn")).cast("long").alias("sites"))
    return titles.unionByName(heads).unionByName(towns)


#: The nation that a nation's suppliers belong to: the last with a code at or before it in its sheet.
_STRUCTURE_SQL = """n AS (SELECT n_nationkey AS k, n_name, n_regionkey AS r, max(CASE WHEN n_nationkey % 12 <> 7 THEN n_nationkey END) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation),
t AS (SELECT s_suppkey, s_name, r, p FROM supplier JOIN n ON s_nationkey = k)"""


@query(f"""WITH {_STRUCTURE_SQL}
SELECT 'P' || CAST(k AS VARCHAR) AS code, n_name AS nom, 'Z' || CAST(r AS VARCHAR) AS zone, CASE WHEN k % 4 = 3 THEN 'insert' WHEN k % 4 = 2 THEN 'update' ELSE 'unchanged' END AS action FROM n WHERE k % 12 <> 7""")
def structure_provinces(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[0]


@query(f"""WITH {_STRUCTURE_SQL}
SELECT 'P' || CAST(p AS VARCHAR) AS province, CAST(s_suppkey AS VARCHAR) AS code, s_name AS nom, CAST(s_suppkey % 9 AS BIGINT) AS sites, CASE WHEN s_suppkey % 3 = 0 THEN 'insert' WHEN s_suppkey % 9 = 4 THEN 'update' ELSE 'unchanged' END AS action FROM t WHERE p IS NOT NULL""")
def structure_territories(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d)[1]


def _structure(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The plan against a state in which some provinces and towns are absent or differ."""
    sheets = _sheets(spark, d)
    key = F.col("n_nationkey")
    provinces = read(spark, d, "nation").filter(key % 4 != 3).select(F.concat(F.lit("P"), key.cast("string")).alias("code"), F.when(key % 4 == 2, "autre").otherwise(F.col("n_name")).alias("nom"), F.concat(F.lit("Z"), F.col("n_regionkey").cast("string")).alias("zone"))
    rows = i.structure_rows(sheets).filter("kind = 'taken' AND territory_code IS NOT NULL")
    town = F.col("territory_code").cast("long")
    territories = rows.filter(town % 3 != 0).select("province", F.col("territory_code").alias("code"), F.col("territory_name").alias("nom"), F.when(town % 9 == 4, F.col("sites") + 1).otherwise(F.col("sites")).alias("sites"))
    return i.structure_plan(sheets, provinces, territories)


@query(f"""WITH {_STRUCTURE_SQL}, s AS (SELECT count(*) FILTER (p IS NULL) AS lost, count(*) FILTER (p IS NOT NULL) AS taken, count(*) FILTER (p IS NULL AND s_suppkey % 10 = 0) AS lost_twice, count(*) FILTER (p IS NOT NULL AND s_suppkey % 10 = 0) AS twice FROM t),
h AS (SELECT count(*) FILTER (p IS NULL) AS lost, count(*) FILTER (p IS NOT NULL) AS taken FROM n)
SELECT 'ignored' AS kind, CAST((SELECT count(DISTINCT r) FROM n) AS BIGINT) AS n UNION ALL SELECT 'taken', s.taken + h.taken FROM s, h UNION ALL SELECT 'repeated', twice FROM s WHERE twice > 0 UNION ALL SELECT 'error', s.lost + lost_twice + h.lost FROM s, h WHERE s.lost + lost_twice + h.lost > 0""")
def structure_row_kinds(spark: SparkSession, d: str) -> DataFrame:
    return i.structure_rows(_sheets(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_ISSUES_SQL}, i AS (SELECT 'EMPTY_NAME' AS issue FROM j WHERE name_key = '' UNION ALL SELECT 'MISSING_CODE' FROM j WHERE code IS NULL UNION ALL SELECT 'DUPLICATE_CODE' FROM j WHERE code IS NOT NULL AND codes > 1
UNION ALL SELECT 'DUPLICATE_NAME' FROM j WHERE name_key <> '' AND names > 1 UNION ALL SELECT 'INVALID_GEOMETRY' FROM j WHERE k % 3 = 1
UNION ALL SELECT 'MISSING_PARENT' FROM j WHERE needs AND ptype IS NULL UNION ALL SELECT 'ORPHAN_ENTITY' FROM j WHERE needs AND parent_id IS NULL
UNION ALL SELECT 'INVALID_HIERARCHY' FROM j WHERE ptype IS NOT NULL AND needs AND NOT (entity_type = 'village' AND ptype = 'groupement' OR entity_type = 'groupement' AND ptype = 'secteur'))
SELECT 'clients' AS source, 'entities' AS section, 'all' AS item, count(*) AS n FROM e UNION ALL SELECT 'clients', 'levels', entity_type, count(*) FROM e GROUP BY entity_type
UNION ALL SELECT 'clients', 'issues', issue, count(*) FROM i GROUP BY issue UNION ALL SELECT 'clients', 'merges', 'candidates', count(*) FROM e a JOIN e b ON a.code = b.code AND a.entity_type = b.entity_type AND a.k < b.k""")
def normalisation_report(spark: SparkSession, d: str) -> DataFrame:
    return i.normalisation_report(prepared_customers(spark, d), "clients")


@query("""SELECT 's' || CAST(s_suppkey AS VARCHAR) AS file, CAST(0 AS BIGINT) AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'GeometryCollection' END AS geometry_type,
CASE s_suppkey % 3 WHEN 0 THEN '{"type":"Point","coordinates":[' || x || ',2.5,7.0]}' WHEN 1 THEN '{"type":"Polygon","coordinates":[[[' || x || ',0.0],[9.5,1.0],[' || x || ',0.0]]]}'
ELSE '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[' || x || ',1.0]},{"type":"LineString","coordinates":[[' || x || ',0.0],[9.5,1.0]]}]}' END AS geometry
FROM (SELECT s_suppkey, CAST(s_suppkey % 90 AS VARCHAR) || '.0' AS x FROM supplier)""")
def kml_geometries(spark: SparkSession, d: str) -> DataFrame:
    """One document a supplier: points with altitude, polygons with a hole, several geometries of one placemark."""
    x = (F.col("s_suppkey") % 90).cast("string")
    turn = F.col("s_suppkey") % 3
    point = F.concat(F.lit("<Point><coordinates>"), x, F.lit(",2.5,7</coordinates></Point>"))
    ring = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), x, F.lit(",0 9.5,1,3 "), x, F.lit(",0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,1 2,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon>"))
    many = F.concat(F.lit("<MultiGeometry><Point><coordinates>"), x, F.lit(",1</coordinates></Point><Polygon/><LineString><coordinates>"), x, F.lit(",0,5 9.5,1,5</coordinates></LineString></MultiGeometry>"))
    body = F.when(turn == 0, point).when(turn == 1, ring).otherwise(many)
    text = F.concat(F.lit("<kml><Document><Placemark><name>a</name>"), body, F.lit("</Placemark></Document></kml>"))
    docs = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return docs.mapInPandas(kml.geometries, kml.GEOMETRY_SCHEMA)


_SHAPES_SQL = """s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 90 AS VARCHAR) || '.5' AS x, s_suppkey % 6 AS turn FROM supplier), p AS (
  SELECT k, x, turn, '[[[' || x || ',0.0,7.0],[9.5,1.0,7.0],[' || x || ',2.0,7.0],[' || x || ',0.0,7.0]],[[' || x || ',1.0],[2.0,2.0],[' || x || ',1.0]]]' AS hole, '[[[' || x || ',3.0],[4.0,4.0],[' || x || ',3.0]]]' AS plain FROM s)"""


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with a geometry of each kind: points with altitude, lines, polygons with holes, several of them,
    collections, and none."""
    x, k = (F.col("s_suppkey") % 90 + 0.5).cast("double"), F.col("s_suppkey")
    at = lambda *p: F.array(*(c if not isinstance(c, float) else F.lit(c) for c in p))
    hole = g.part("Polygon", F.array(F.array(at(x, 0.0, 7.0), at(9.5, 1.0, 7.0), at(x, 2.0, 7.0), at(x, 0.0, 7.0)), F.array(at(x, 1.0), at(2.0, 2.0), at(x, 1.0))))
    plain = g.part("Polygon", F.array(F.array(at(x, 3.0), at(4.0, 4.0), at(x, 3.0))))
    point = g.part("Point", F.array(F.array(at(x, 2.5, 7.0))))
    line = g.part("LineString", F.array(F.array(at(x, 0.0, 1.0), at(9.5, 1.0))))
    turn = k % 6
    kinds = [F.array(point), F.array(hole), F.array(hole, plain), F.array(point, line, hole), F.array(line)]
    parts = F.when(turn == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], 1):
        parts = parts.when(turn == i, kind)
    return read(spark, d, "supplier").select(k, F.col("s_name").alias("nom"), g.whole(parts).alias("geometry"))


@query(f"""WITH {_SHAPES_SQL}
SELECT 's' || CAST(k AS VARCHAR) AS file, CASE turn WHEN 0 THEN '{{"type":"Point","coordinates":[' || x || ',2.5,7.0]}}' WHEN 1 THEN '{{"type":"Polygon","coordinates":' || hole || '}}'
  WHEN 2 THEN '{{"type":"MultiPolygon","coordinates":[' || hole || ',' || plain || ']}}'
  WHEN 3 THEN '{{"type":"GeometryCollection","geometries":[{{"type":"Point","coordinates":[' || x || ',2.5,7.0]}},{{"type":"LineString","coordinates":[[' || x || ',0.0,1.0],[9.5,1.0]]}},{{"type":"Polygon","coordinates":' || hole || '}}]}}'
  ELSE '{{"type":"LineString","coordinates":[[' || x || ',0.0,1.0],[9.5,1.0]]}}' END AS feature_geometry,
  CASE WHEN turn <> 3 THEN CAST(x AS DOUBLE) END AS lon, CASE turn WHEN 0 THEN 2.5 WHEN 3 THEN NULL ELSE 0.0 END AS lat, CASE turn WHEN 0 THEN 7.0 WHEN 3 THEN NULL WHEN 4 THEN 1.0 ELSE 7.0 END AS alt, true AS same
FROM p WHERE turn < 5""")
def geometry_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whole geometries through KML documents, a zip each, and through GeoJSON text and back."""
    rows = _shapes(spark, d)
    text = F.concat(F.lit("<kml><Document><name>d</name>"), shape_placemark(F.col("nom"), F.col("geometry")), F.lit("</Document></kml>"))
    docs = rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    back = docs.mapInPandas(zipped, "path string, content binary").mapInPandas(kml.shapes, kml.SHAPE_SCHEMA)
    out = back.withColumn("feature_geometry", g.geojson(F.col("geometry"))).withColumn("first", g.first_point(F.col("geometry")))
    again = g.from_geojson(F.col("feature_geometry")).eqNullSafe(F.col("geometry"))
    return out.select("file", "feature_geometry", "first.lon", "first.lat", "first.alt", again.alias("same"))


def zipped(batches):
    """(path, content): each content as the only member of a zip archive."""
    import io
    import zipfile

    for batch in batches:
        held = []
        for content in batch["content"]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("doc.kml", bytes(content))
            held.append(out.getvalue())
        yield batch.assign(content=held)


@query(f"""WITH {_SHAPES_SQL}, z AS (SELECT p.*, s_name AS nom, s_nationkey FROM p JOIN supplier ON k = s_suppkey)
SELECT k AS s_suppkey, '{{"type":"Feature","properties":{{"layer":"localites","nom":"' || nom || '","statut":null}},"geometry":' || CASE turn WHEN 0 THEN '{{"type":"Point","coordinates":[' || x || ',2.5,7.0]}}'
  WHEN 1 THEN '{{"type":"Polygon","coordinates":' || hole || '}}' WHEN 2 THEN '{{"type":"MultiPolygon","coordinates":[' || hole || ',' || plain || ']}}'
  WHEN 3 THEN '{{"type":"GeometryCollection","geometries":[{{"type":"Point","coordinates":[' || x || ',2.5,7.0]}},{{"type":"LineString","coordinates":[[' || x || ',0.0,1.0],[9.5,1.0]]}},{{"type":"Polygon","coordinates":' || hole || '}}]}}'
  ELSE '{{"type":"LineString","coordinates":[[' || x || ',0.0,1.0],[9.5,1.0]]}}' END || '}}' AS feature FROM z WHERE turn < 5""")
def map_layer_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The features of a layer of any geometries; rows without one have none."""
    rows = g.layer(_shapes(spark, d), "geometry", layer=F.lit("localites"), nom=F.col("nom"), statut=F.lit(None).cast("string"))
    return rows.select("s_suppkey", "feature")


_BOOK_SQL = """w AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 10 > 0 THEN c_name END AS nom, 'T' || CAST(c_custkey % 500 AS VARCHAR) AS code, CASE WHEN c_custkey % 9 = 0 THEN 'XX' ELSE 'N' || CAST(c_nationkey AS VARCHAR) END AS province FROM customer),
p AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_nationkey <> 3),
e AS (SELECT p.code AS province, 'T' || CAST(x AS VARCHAR) AS code FROM p, (SELECT unnest(range(10)) AS x)),
v AS (SELECT w.*, nom IS NOT NULL AND province IN (SELECT code FROM p) AS ok FROM w),
f AS (SELECT province, code, min(ord) AS first FROM v WHERE ok GROUP BY province, code)"""


@query(f"""WITH {_BOOK_SQL}, r AS (SELECT v.ord, v.code, v.province, CASE WHEN nom IS NULL THEN 'champ manquant' WHEN v.province NOT IN (SELECT code FROM p) THEN 'parent introuvable' WHEN e.code IS NOT NULL THEN 'déjà présent' WHEN v.ord > first THEN 'répété' END AS reason
  FROM v LEFT JOIN e ON v.province = e.province AND v.code = e.code LEFT JOIN f ON v.province = f.province AND v.code = f.code)
SELECT ord, code, province, CASE WHEN reason IS NULL THEN 'insert' WHEN reason = 'parent introuvable' THEN 'error' ELSE 'skip' END AS action, reason FROM r""")
def workbook_import(spark: SparkSession, d: str) -> DataFrame:
    """Territories written to workbooks by all tasks, read back by column letters from the zipped files, and planned."""
    k = F.col("c_custkey")
    province = F.when(k % 9 == 0, "XX").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    book = read(spark, d, "customer").select(F.when(k % 10 > 0, F.col("c_name")).alias("nom"), F.concat(F.lit("T"), (k % 500).cast("string")).alias("code"), province.alias("province"), k.alias("ord"))
    path = folder(spark, "books")
    committed.write(book.repartition(4, "ord"), path, "xlsx", "Territoires")
    rows = xlsx.read_table(spark, f"{path}/part-*.xlsx", {"A": "nom", "B": "code", "C": "province", "D": "ord"})
    rows = rows.select(F.col("ord").cast("long"), "nom", "code", "province")
    provinces = read(spark, d, "nation").filter("n_nationkey <> 3").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    existing = provinces.select(F.col("code").alias("province"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.concat(F.lit("T"), x.cast("string")))).alias("code"))
    return i.positional_import(rows, "ord", ["nom", "code", "province"], ["province", "code"], existing, provinces, "province").drop("nom")


@query("""SELECT c_name || ' <' || c_mktsegment || '>' AS name, '[' || CAST(c_custkey % 180 AS VARCHAR) || '.0, ' || CAST(c_nationkey AS VARCHAR) || '.0]' AS coordinates FROM customer""")
def kml_documents_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Placemarks in KML documents of 1000 each, committed together, and read back from the files."""
    rows = read(spark, d, "customer")
    name = F.concat("c_name", F.lit(" <"), "c_mktsegment", F.lit(">"))
    marks = rows.select(placemark(name, (F.col("c_custkey") % 180).cast("double"), F.col("c_nationkey").cast("double")).alias("placemark"))
    path = folder(spark, "kml")
    committed.write(marks.repartition(3), path, "kml", "Clients", most_rows=1000)
    return kml.read_placemarks(spark, f"{path}/part-*.kml").select("name", "coordinates")


@query("""SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey % 5 = 0 END AS cinq FROM supplier""")
def json_documents_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Indented JSON documents, committed together, and read back as records."""
    k = F.col("s_nationkey")
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.when(k % 2 == 0, k % 5 == 0).alias("cinq"))
    path = folder(spark, "json")
    committed.write(rows.repartition(3, "s_suppkey"), path, "json", "Fournisseurs", most_rows=200)
    return geojson.read_records(spark, f"{path}/part-*.json", "rows").select("s_suppkey", "s_name", "s_acctbal", "cinq")
