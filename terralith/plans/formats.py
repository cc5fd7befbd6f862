"""Queries through files: tables written in each format into the shared folder, and read back by the readers."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.text import xml_escape
from terralith.operators import geometry as g
from terralith.operators import upsert as u
from terralith.operators.decision import page
from terralith.plans.tables import read
from terralith.scratch import folder
from terralith.sources import committed, geojson, kml, sinks, tabular

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name || ' "a"; b' AS nom, CASE WHEN s_nationkey % 3 > 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Quoted fields with separators and quotes in them, blanks as null; the separator is found by the reader."""
    k = F.col("s_nationkey")
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.concat("s_name", F.lit(' "a"; b')).alias("nom"), F.when(k % 3 > 0, k).alias("nation"))
    path = folder(spark, "csv")
    sinks.write_csv(rows, path)
    return tabular.read_csv(spark, path)


def _zip_members(batches):
    """(path, names, texts): the texts as the members of a zip archive."""
    for batch in batches:
        held = []
        for names, texts in zip(batch["names"], batch["texts"]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in zip(names, texts):
                    z.writestr(name, text)
            held.append(out.getvalue())
        yield batch[["path"]].assign(content=held)


@query("""WITH s AS (SELECT s_suppkey, s_name, s_nationkey, CAST(s_suppkey % 90 AS VARCHAR) AS x FROM supplier)
SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.zip' AS file, 'cod_admin1' AS layer, 'province' AS level, CAST(0 AS BIGINT) AS ord, 'cod_admin1' AS folder, 'Point' AS geometry_type, s_name AS nom, CAST(s_nationkey AS VARCHAR) AS n FROM s
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.zip', 'capitals', 'chef_lieu', 0, 'Villes', NULL, s_name || ' 2', NULL FROM s
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.zip', 'capitals', 'chef_lieu', 1, 'capitals', 'LineString', NULL, 'true' FROM s""")
def zipped_geojson_layers(spark: SparkSession, d: str) -> DataFrame:
    """An archive of two layers a supplier: folders from properties or the layer's name, levels from that name."""
    x = (F.col("s_suppkey") % 90).cast("string")
    name = F.to_json(F.struct(F.col("s_name").alias("v")))
    text = F.regexp_extract(name, r'^\{"v":(.*)\}$', 1)
    feature = lambda properties, geometry: F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}"))
    one = feature(F.concat(F.lit('{"nom":'), text, F.lit(',"n":'), F.col("s_nationkey").cast("string"), F.lit(',"vide":null}')), F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(",1]}")))
    two = feature(F.concat(F.lit('{"folder":"Villes","nom":'), F.regexp_replace(text, '"$', ' 2"'), F.lit("}")), F.lit("null"))
    three = feature(F.lit('{"n":true}'), F.concat(F.lit('{"type":"LineString","coordinates":[['), x, F.lit(",1],[2,3]]}")))
    layer = lambda *features: F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *features), F.lit("]}"))
    names = F.array(F.lit("a/cod_admin1.geojson"), F.lit("readme.txt"), F.lit("capitals.json"))
    rows = read(spark, d, "supplier").select(F.format_string("s%d.zip", "s_suppkey").alias("path"), names.alias("names"), F.array(layer(one), F.lit("no"), layer(two, three)).alias("texts"))
    found = rows.mapInPandas(_zip_members, "path string, content binary").mapInPandas(geojson.features, geojson.FEATURES)
    return found.select("file", "layer", geojson.layer_level(F.col("layer")).alias("level"), "ord", "folder", "geometry_type", F.col("properties")["nom"].alias("nom"), F.col("properties")["n"].alias("n"))


@query("""SELECT 'lu' AS origine, s_suppkey, s_name FROM supplier UNION ALL SELECT 'absent', NULL, NULL WHERE false""")
def json_report_preview(spark: SparkSession, d: str) -> DataFrame:
    """A report whose list is found without naming it, and one that isn't written yet, which has no rows."""
    path = folder(spark, "report")
    committed.write(read(spark, d, "supplier").select("s_suppkey", "s_name"), path, "json", "rapport")
    there = geojson.read_records(spark, f"{path}/part-*.json").select(F.lit("lu").alias("origine"), "s_suppkey", "s_name")
    none = geojson.read_records(spark, f"{path}/missing.json", schema="s_suppkey long, s_name string")
    return there.unionByName(none.select(F.lit("absent").alias("origine"), "s_suppkey", "s_name"))


@query("""SELECT s_name AS name, 'ff' || lpad(CAST(s_nationkey AS VARCHAR), 6, '0') AS line_color, CASE WHEN s_nationkey % 2 = 0 THEN '7f0000ff' END AS poly_color FROM supplier WHERE s_nationkey % 5 > 0""")
def styles_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Shared styles joined to the placemarks that name them, document by document; some name none that is there."""
    k = F.col("s_nationkey")
    poly = F.when(k % 2 == 0, "<PolyStyle><color>7f0000ff</color></PolyStyle>").otherwise("")
    style = F.concat(F.format_string('<Style id="s%d"><LineStyle><color>ff%06d</color></LineStyle>', "s_suppkey", k), poly, F.lit("</Style>"))
    mark = F.concat(F.lit("<Placemark><name>"), xml_escape("s_name"), F.lit("</name><styleUrl>#"), F.when(k % 5 > 0, F.format_string("s%d", "s_suppkey")).otherwise("none"), F.lit("</styleUrl></Placemark>"))
    path = folder(spark, "styles")
    committed.write(read(spark, d, "supplier").select(F.concat(style, mark).alias("placemark")).repartition(3), path, "kml", "Styles", most_rows=100)
    marks, styles = kml.read_placemarks(spark, f"{path}/part-*.kml"), kml.resolved_styles(spark, f"{path}/part-*.kml")
    styles = styles.select(F.col("file").alias("_file"), "style_id", "line_color", "poly_color")
    return marks.join(styles, (F.col("file") == F.col("_file")) & (F.col("style_url") == F.col("style_id"))).select("name", "line_color", "poly_color")


@query("""SELECT r_name AS name, n_name AS province, CASE r_regionkey % 5 WHEN 0 THEN 'ND' WHEN 1 THEN 'OT' WHEN 2 THEN 'CE' WHEN 3 THEN 'SD' ELSE 'ET' END AS code, '#' || CAST(r_regionkey AS VARCHAR) AS colour, 'v1' AS config_version FROM nation JOIN region ON n_regionkey = r_regionkey""")
def zone_configuration(spark: SparkSession, d: str) -> DataFrame:
    """A zone configuration written from regions and nations (a row each, bounded) and parsed again."""
    codes = ["ND", "OT", "CE", "SD", "ET"]
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_name").orderBy("r_regionkey", "n_name").collect()
    lines = ["zones:  # des zones"]
    for key in sorted({(r["r_regionkey"], r["r_name"]) for r in rows}):
        lines += [f'  - code: "{codes[key[0] % 5]}"', f"    nom: {key[1]}", f"    couleur: '#{key[0]}'", "    provinces:"]
        lines += [f"      - {r['n_name']}" for r in rows if r["r_regionkey"] == key[0]]
    return tabular.zone_table(spark, "\n".join(lines), "v1")


_PLAN_SQL = """a AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'update' WHEN c_custkey % 4 = 1 THEN 'unchanged' ELSE 'insert' END AS action, count(*) AS n FROM customer GROUP BY 1)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as staged rows of which half are known, a quarter with another name."""
    k = F.col("c_custkey")
    staged = read(spark, d, "customer").select(k.alias("ord"), k.cast("string").alias("code"), F.col("c_name").alias("nom"))
    existing = read(spark, d, "customer").filter(k % 4 < 2).select(k.cast("string").alias("code"), F.when(k % 4 == 0, "autre").otherwise(F.col("c_name")).alias("nom"))
    return u.planned_actions(staged, existing, "code", ["nom"])


@query(f"""WITH {_PLAN_SQL} SELECT source, as_of, action, CAST(n AS BIGINT) AS n FROM a, (SELECT 'kml' AS source, '2024-01-01' AS as_of UNION ALL SELECT 'xlsx', '2024-01-02')""")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Two runs appended to the history of imports."""
    path = folder(spark, "runs")
    counts = u.preview(_plan(spark, d))
    sinks.append_run(counts, path, "kml", "2024-01-01")
    sinks.append_run(counts, path, "xlsx", "2024-01-02")
    return spark.read.parquet(path).select("source", "as_of", "action", "n")


@query(f"""WITH {_PLAN_SQL} SELECT stem, action, CAST(n AS BIGINT) AS n, CAST(2 AS BIGINT) AS files FROM a, (SELECT 'import' AS stem UNION ALL SELECT 'latest')""")
def catalogue_twice(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue under its own name and as the latest one, and the manifest of what was written."""
    path = folder(spark, "catalogue")
    paths = sinks.write_twice(u.preview(_plan(spark, d)), path, "import")
    sinks.write_manifest(spark, paths, f"{path}/manifest")
    files = spark.read.json(f"{path}/manifest").agg(F.count_if(F.col("created_file").endswith(".catalog")).alias("files"))
    out = None
    for stem in ("import", "latest"):
        part = spark.read.schema("action string, n long").json(f"{path}/{stem}.catalog").select(F.lit(stem).alias("stem"), "action", "n")
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(files))  # one row


@query("""SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS code, 'insert' AS action FROM customer""")
def strict_import(spark: SparkSession, d: str) -> DataFrame:
    """An import without a single reject goes through whole."""
    k = F.col("c_custkey")
    staged = read(spark, d, "customer").select(k.alias("ord"), k.cast("string").alias("code"), F.col("c_name").alias("nom"))
    return u.strict(u.planned_actions(staged, staged.limit(0).drop("ord"), "code", ["nom"])).select("ord", "code", "action")


@query("""SELECT s.c_custkey AS ord, s.c_name AS nom, 'K' || CAST(s.c_custkey AS VARCHAR) AS code, CASE WHEN e.c_custkey % 3 = 0 THEN 'X' ELSE 'K' END || CAST(e.c_custkey AS VARCHAR) AS existing_code FROM customer s JOIN customer e ON s.c_name = e.c_name AND e.c_custkey % 2 = 0 WHERE s.c_custkey <> e.c_custkey OR e.c_custkey % 3 = 0""")
def same_name_other_code(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    staged = read(spark, d, "customer").select(k.alias("ord"), F.col("c_name").alias("nom"), F.concat(F.lit("K"), k.cast("string")).alias("code"))
    existing = read(spark, d, "customer").filter(k % 2 == 0).select(F.col("c_name").alias("nom"), F.concat(F.when(k % 3 == 0, "X").otherwise("K"), k.cast("string")).alias("code"))
    return u.same_name_other_code(staged, existing, "nom", "code")


@query("""SELECT s_suppkey AS code, CASE WHEN s_suppkey % 4 = 0 THEN 'Sans nom' ELSE s_name END AS nom, upper(coalesce(CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS VARCHAR) END, CAST(s_nationkey AS VARCHAR), '?')) AS repere, 'actif' AS statut FROM supplier""")
def mapped_profile(spark: SparkSession, d: str) -> DataFrame:
    """Canonical fields from a profile: the first filled source, a default, a function of columns."""
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select(k, F.when(k % 4 > 0, F.col("s_name")).otherwise("  ").alias("NOM"), F.when(k % 3 > 0, k).alias("a"), F.col("s_nationkey").alias("b"))
    profile = {"code": {"from": ["s_suppkey"], "transform": lambda c: c.cast("long")}, "nom": {"from": ["Nom", "NOM"], "default": "Sans nom"}, "repere": {"from": ["a", "b"], "default": "?", "transform": F.upper}, "statut": {"from": ["absent"], "default": "actif"}}
    return tabular.mapped(rows, profile)


@query("""SELECT s_name AS nom, CAST(s_suppkey AS VARCHAR) AS code, CAST(s_nationkey AS VARCHAR) AS province, 'latitude,longitude' AS manquants, 'Sites Fournisseurs' AS feuille FROM supplier""")
def detected_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by alias, exact ones before parts; required ones that no header has; a sheet found by part."""
    rows = read(spark, d, "supplier").select(F.col("s_name").alias("Désignation du site"), F.col("s_suppkey").alias("Code-Officiel"), F.col("s_nationkey").alias("PROVINCE "), F.lit(1).alias(" "))
    aliases = {"nom": ["nom", "designation"], "code": ["code_officiel", "code"], "province": ["province"], "latitude": ["lat"]}
    found = tabular.detect_columns(rows.columns, aliases)
    renamed = tabular.rename(rows, found)
    missing = ",".join(tabular.missing_columns(renamed, ["nom", "code", "latitude", "longitude"]))
    sheet = tabular.detect_sheet(["Notes", "Sites Fournisseurs"], "sites")
    return renamed.select("nom", "code", "province", F.lit(missing).alias("manquants"), F.lit(sheet).alias("feuille"))


@query("""SELECT s_suppkey, '| ' || CAST(s_suppkey AS VARCHAR) || ' | ' || s_name || chr(92) || '|x | ' || CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END || ' |' AS ligne FROM supplier""")
def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows of Markdown tables of 100 rows each, committed together."""
    k = F.col("s_nationkey")
    rows = read(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit("|x")).alias("nom"), F.when(k % 2 == 0, k).alias("nation"))
    path = folder(spark, "md")
    committed.write(rows.repartition(3, "s_suppkey"), path, "md", "Fournisseurs", most_rows=100)
    lines = spark.read.text(f"{path}/part-*.md").filter(F.col("value").rlike(r"^\| \d"))
    return lines.select(F.regexp_extract("value", r"^\| (\d+)", 1).cast("long").alias("s_suppkey"), F.col("value").alias("ligne"))


@query("""WITH i AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'Commune' ELSE 'TERRITOIRE' END AS type, c_custkey % 4 > 0 AS there FROM customer),
p AS (SELECT * FROM i WHERE lower(type) = 'territoire' ORDER BY k LIMIT 200 OFFSET 20)
SELECT k, '{"type":"Feature","properties":{"nom":"' || c_name || '","type":"' || type || '"},"geometry":{"type":"Point","coordinates":[' || CAST(k % 180 AS VARCHAR) || '.0,1.5]}}' AS feature FROM p WHERE there""")
def map_layer_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the layer of territories: items of that type in any case, in order; those without a geometry take their
    place in the page and have no feature."""
    k = F.col("c_custkey")
    point = g.whole(F.array(g.part("Point", F.array(F.array(F.array((k % 180).cast("double"), F.lit(1.5)))))))
    items = read(spark, d, "customer").select(k.alias("k"), F.col("c_name").alias("nom"), F.when(k % 3 == 0, "Commune").otherwise("TERRITOIRE").alias("type"), F.when(k % 4 > 0, point).alias("geometry"))
    shown = page(items.filter(F.lower("type") == "territoire"), ["k"], 20, 200)
    return g.layer(shown, "geometry", nom=F.col("nom"), type=F.col("type")).select("k", "feature")
