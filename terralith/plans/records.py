"""Queries of matching classes, identifiers, workbooks, lookups by nomenclature and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators import audit as a
from terralith.operators import classify as c
from terralith.operators import match
from terralith.operators import upsert as u
from terralith.operators.hierarchy import member_rows, tree_rows
from terralith.operators.resolve import find_territories
from terralith.plans.imports import _STAGED_SQL, _plan
from terralith.plans.tables import read
from terralith.sources.xlsx import workbook_entities

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities: brands as codes, sizes as names, so that many are alike."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.lit("part").alias("entity_type"), F.col("p_brand").alias("code"), F.col("p_size").cast("string").alias("name"), F.col("p_brand").alias("parent"))


@query("""SELECT p_partkey AS id, min(p_partkey) OVER w AS class_id, CAST(count(*) OVER w AS BIGINT) AS members FROM part WHERE p_brand IS NOT NULL WINDOW w AS (PARTITION BY p_brand, p_size)""")
def match_membership(spark: SparkSession, d: str) -> DataFrame:
    return match.membership(_kinds(spark, d))


@query("""WITH k AS (SELECT p_brand, p_size, min(p_partkey) AS id FROM part WHERE p_brand IS NOT NULL GROUP BY 1, 2)
SELECT a.id AS left_id, b.id AS right_id, 0.75::DOUBLE AS confidence, 'code identique; meme parent' AS reasons FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.id < b.id""")
def match_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between classes: numbers up to 50 written in digits are never similar enough to count as names."""
    return match.representative_pairs(_kinds(spark, d)).withColumn("reasons", F.array_join("reasons", "; "))


@query("SELECT n_name AS province, c_mktsegment AS segment, c_name AS member FROM customer JOIN nation ON c_nationkey = n_nationkey")
def group_member_rows(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return member_rows(joined.select(F.col("n_name").alias("province"), F.col("c_mktsegment").alias("segment"), "c_name"), ["province", "segment"], F.col("c_name"))


@query("""WITH t AS (SELECT s_suppkey AS ord, 'TER' || CAST(s_suppkey % 60 AS VARCHAR) AS k, regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') AS pk, 'P' || CAST(n_nationkey AS VARCHAR) AS pc, s_name AS territoire FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT pk, k, arg_max(territoire, ord) AS v FROM t GROUP BY 1, 2), y AS (SELECT pc, k, arg_max(territoire, ord) AS v FROM t GROUP BY 1, 2), z AS (SELECT k, arg_min(territoire, ord) AS v FROM t GROUP BY 1),
q AS (SELECT c_custkey, 'TER' || CAST(c_custkey % 70 AS VARCHAR) AS k, CASE WHEN c_custkey % 3 = 0 THEN regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') END AS pk, CASE WHEN c_custkey % 3 = 1 THEN 'P' || CAST(n_nationkey AS VARCHAR) END AS pc FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(x.v, y.v, z.v) AS territoire, CASE WHEN x.v IS NOT NULL THEN 'province' WHEN y.v IS NOT NULL THEN 'code province' WHEN z.v IS NOT NULL THEN 'nom' ELSE 'non rattaché' END AS resolution
FROM q LEFT JOIN x ON q.pk = x.pk AND q.k = x.k LEFT JOIN y ON q.pc = y.pc AND q.k = y.k LEFT JOIN z ON q.k = z.k""")
def nomenclature_territories(spark: SparkSession, d: str) -> DataFrame:
    """Customers find a territory by province and name, province code and name, or name alone."""
    nation = read(spark, d, "nation")
    territories = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    territories = territories.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("Ter "), (F.col("s_suppkey") % 60).cast("string")).alias("nom"), F.col("n_name").alias("province"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("province_code"), F.col("s_name").alias("territoire"))
    turn = F.col("c_custkey") % 3
    asked = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = asked.select("c_custkey", F.concat(F.lit("TER-"), (F.col("c_custkey") % 70).cast("string")).alias("_n"), F.when(turn == 0, F.lower("n_name")).alias("_p"), F.when(turn == 1, F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))).alias("_c"))
    return find_territories(asked, F.col("_n"), F.col("_p"), F.col("_c"), territories, ["territoire"]).select("c_custkey", "territoire", "resolution")


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'SECTEUR' WHEN 1 THEN 'Commune' ELSE '' END AS own, CASE p_size % 3 WHEN 0 THEN 'la chefferie' ELSE p_type END AS nature,
  CASE p_size % 7 WHEN 0 THEN 'Secteur ' || p_name ELSE p_name END AS html, CASE p_size % 2 WHEN 0 THEN 'Chefferies' ELSE p_brand END AS folder FROM part),
k AS (SELECT p_partkey, CASE WHEN contains(lower(own), 'secteur') THEN 'Secteur' WHEN contains(lower(own), 'chefferie') THEN 'Chefferie' WHEN lower(own) IN ('commune', 'ville') THEN 'Autre' END AS a,
  CASE WHEN contains(lower(nature), 'secteur') THEN 'Secteur' WHEN contains(lower(nature), 'chefferie') THEN 'Chefferie' END AS b,
  CASE WHEN contains(lower(html), 'secteur') THEN 'Secteur' WHEN contains(lower(html), 'chefferie') THEN 'Chefferie' END AS c,
  CASE WHEN contains(lower(folder), 'secteur') THEN 'Secteur' WHEN contains(lower(folder), 'chefferie') THEN 'Chefferie' END AS e FROM p)
SELECT p_partkey, coalesce(a, b, c, e, 'Type inconnu') AS type, CASE WHEN a IS NOT NULL THEN 'TYPE' WHEN b IS NOT NULL THEN 'ExtendedData' WHEN c IS NOT NULL THEN 'Description' WHEN e IS NOT NULL THEN 'Arborescence KMZ' ELSE 'Non determine' END AS type_source FROM k""")
def collectivity_types(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a type in an attribute, in another, in the text or in a folder."""
    size = F.col("p_size")
    own = F.when(size % 5 == 0, "SECTEUR").when(size % 5 == 1, "Commune").otherwise("")
    nature = F.when(size % 3 == 0, "la chefferie").otherwise(F.col("p_type"))
    ext = F.array(F.struct(F.lit("TYPE").alias("k"), own.alias("v")), F.struct(F.lit("Nature").alias("k"), nature.alias("v")))
    html = F.when(size % 7 == 0, F.concat(F.lit("Secteur "), "p_name")).otherwise(F.col("p_name"))
    path = F.array(F.lit("racine"), F.when(size % 2 == 0, "Chefferies").otherwise(F.col("p_brand")))
    rows = read(spark, d, "part").select("p_partkey", ext.alias("ext"), html.alias("html"), path.alias("path"))
    kind, source = c.collectivity_type(F.col("ext"), F.col("html"), F.col("path"))
    return rows.select("p_partkey", kind.alias("type"), source.alias("type_source"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Territoire' WHEN p_size % 3 = 1 THEN 'Commune' WHEN p_size % 2 = 0 THEN 'Ville' ELSE 'Autre' END AS type FROM part""")
def audit_types(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, " TERRITOIRE").when(size % 3 == 1, "communes")
    return read(spark, d, "part").select("p_partkey", c.audit_type(kind, F.when(size % 2 == 0, F.lit("Goma ")).otherwise(F.col("p_name"))).alias("type"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'ZONE X' WHEN 1 THEN 'PROVINCE' WHEN 2 THEN 'KASAI ND' ELSE upper(c_name) END AS name, CASE c_custkey % 4 WHEN 0 THEN 'Village' END AS level, CASE WHEN c_custkey % 7 = 0 THEN n_name END AS province, CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS territory, CASE WHEN c_custkey % 2 = 0 THEN 'Polygon' ELSE 'Point' END AS g FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN contains(name, 'ZONE ') OR regexp_matches(name, ' (ND|SD|CE|OT|ET)') THEN 'zone' WHEN contains(name, 'PROVINCE') THEN 'province' WHEN upper(level) = 'VILLAGE' THEN 'village'
  WHEN territory IS NOT NULL AND province IS NULL THEN 'territoire' WHEN province IS NOT NULL AND g = 'Polygon' AND territory IS NULL THEN 'province' WHEN g = 'Point' THEN 'village' ELSE 'unknown' END AS entity_type FROM t""")
def staging_types(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 6 == 0, "ZONE X").when(key % 6 == 1, "PROVINCE").when(key % 6 == 2, "KASAI ND").otherwise(F.upper("c_name"))
    level = F.when(key % 4 == 0, "Village")
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = c.staging_type(F.array_compact(F.array(name, F.upper(level))), F.lit(None).cast("string"), F.when(key % 7 == 0, F.col("n_name")), F.when(key % 5 == 0, "x"), F.when(key % 2 == 0, "Polygon").otherwise("Point"))
    return rows.select("c_custkey", kind.alias("entity_type"))


@query(f"WITH {_STAGED_SQL} SELECT ord, reason FROM planned WHERE action = 'reject' ORDER BY ord LIMIT 50")
def import_errors(spark: SparkSession, d: str) -> DataFrame:
    return u.first_errors(_plan(spark, d))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 2 THEN s_nationkey END AS s_nationkey FROM supplier")
def optional_parents(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers after some nations are deleted: the reference goes, the row stays."""
    gone = read(spark, d, "nation").filter("n_nationkey % 5 = 2").select(F.col("n_nationkey").alias("key"))
    return u.set_null(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", gone)


@query("""SELECT 'zones' AS layer, 'Z' || CAST(n_regionkey AS VARCHAR) AS code, coalesce(r_name, 'Zone') AS nom, n_name AS province, '{"type":"Point","coordinates":[' || CAST(n_nationkey AS VARCHAR) || ',0]}' AS geometry
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 3 WHERE n_nationkey % 4 <> 0""")
def map_zone_layer(spark: SparkSession, d: str) -> DataFrame:
    """The layer of zones, made from the nations that have a geometry; one zone has no name."""
    geometry = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit('{"type":"Point","coordinates":['), F.col("n_nationkey").cast("string"), F.lit(",0]}"))).otherwise("")
    provinces = read(spark, d, "nation").select(F.col("n_name").alias("nom"), F.concat(F.lit("Z"), F.col("n_regionkey").cast("string")).alias("zone"), geometry.alias("geometry"))
    zones = read(spark, d, "region").filter("r_regionkey <> 3").select(F.concat(F.lit("Z"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("nom"))
    return a.zone_layer(provinces, zones)


@query("""WITH m AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'COLLECTIV' WHEN 1 THEN 'TERRITOIRE' ELSE 'AUTRE' END AS field FROM lineitem) SELECT field, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY field""")
def mismatch_by_field(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("l_linenumber") % 3
    message = F.when(turn == 2, F.lit("geometrie absente")).otherwise(F.format_string("%s source='%s' parent='%s'", F.when(turn == 0, "COLLECTIV").otherwise("TERRITOIRE"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")))
    return a.mismatch_fields(read(spark, d, "lineitem").select(message.alias("message")), "message")


@query("""WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'ND' ELSE 'INCONNU' END AS z, regexp_replace(upper(s_name), '[^A-Z0-9]+', '', 'g') AS nom, regexp_replace(upper(s_name), '[^A-Z0-9]+', '_', 'g') AS lieu,
  CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'SANS_CODE' END AS code, CASE WHEN s_suppkey % 5 > 0 THEN replace(upper(n_name), ' ', '_') END AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, 'RDC-' || z || '-VILLE-' || nom AS ville, 'RDC-' || z || '-COLL-' || coalesce(p, 'TERRITOIRE_INCONNU') || '-SECTEUR-' || nom AS collectivite,
  'RDC-' || z || '-GRPT-' || coalesce(p, 'COLLECTIVITE_INCONNUE') || '-' || nom || '-' || code AS groupement, 'RDC-' || z || '-LOC-' || coalesce(p, 'TERRITOIRE_INCONNU') || '-' || coalesce(p, 'PARENT_INCONNU') || '-' || lieu || '-' || code AS localite FROM e""")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    zone, code, place = F.when(key % 3 > 0, "ND"), F.when(key % 4 > 0, key.cast("string")).otherwise(""), F.when(key % 5 > 0, F.col("n_name"))
    made = {kind: a.canonical_ids(kind, zone, F.col("s_name"), code, place, F.lit("Secteur") if kind == "collectivite" else place) for kind in ("ville", "collectivite", "groupement", "localite")}
    return rows.select("s_suppkey", *(v.alias(k) for k, v in made.items()))


@query("""WITH t AS (SELECT r_name, n_name, grouping(n_name) AS g FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name) HAVING grouping(r_name) = 0)
SELECT trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN g = 0 THEN '--' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') ELSE '' END AS id FROM t""")
def tree_node_ids(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tree_rows(joined.select("r_name", "n_name"), ["r_name", "n_name"]).select(a.tree_ids(F.col("path")).alias("id"))


@query("""SELECT o_orderkey, 'code sans parent connu' AS cause FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 9 <> 0 UNION ALL SELECT o_orderkey, 'code absent' FROM orders WHERE o_custkey % 9 = 0""")
def orphan_details(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers that aren't known, or that name none."""
    key = F.col("o_custkey")
    orders = read(spark, d, "orders").select("o_orderkey", F.when(key % 9 != 0, key).alias("parent"))
    known = read(spark, d, "orders").filter("o_custkey % 3 <> 0").select("o_custkey").distinct()
    return a.orphan_audit(orders, known, "parent", "o_custkey").select("o_orderkey", "cause")


@query("""WITH s AS (SELECT s_suppkey, 'Feuille ' || upper(substr(r_name, 1, 2)) AS sheet, upper(substr(r_name, 1, 2)) AS zone_code, n_name, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'zone' AS level, sheet AS raw_name, zone_code AS raw_code, NULL AS parent_code, zone_code, NULL AS province_name, NULL AS territory_name, NULL AS sites FROM (SELECT DISTINCT sheet, zone_code FROM s)
UNION ALL SELECT 'province', n_name, 'P' || CAST(n_nationkey AS VARCHAR), zone_code, zone_code, n_name, NULL, NULL FROM (SELECT DISTINCT n_name, n_nationkey, zone_code FROM s)
UNION ALL SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'ville' ELSE 'territoire' END, CASE WHEN s_suppkey % 5 = 0 THEN 'Ville ' ELSE 'T' END || CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), 'P' || CAST(n_nationkey AS VARCHAR), zone_code, n_name,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'T' || CAST(s_suppkey AS VARCHAR) END, '7' FROM s""")
def workbook_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells as the official workbook has them, a sheet a region: province rows, then the suppliers of each."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.upper(F.substring("r_name", 1, 2))
    at = nation.select("n_nationkey", "n_name", F.lit("w.xlsx").alias("file"), F.col("r_regionkey").cast("int").alias("sheet_ord"), F.concat(F.lit("Feuille "), code).alias("sheet"))
    joined = at.join(read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    first = (F.col("n_nationkey") * 1000000).cast("int")
    pair = lambda c, v: F.struct(F.lit(c).alias("col"), v.cast("string").alias("value"))
    heads = joined.select("file", "sheet_ord", "sheet", "n_nationkey", "n_name").distinct().select("file", "sheet_ord", "sheet", first.alias("row"), F.explode(F.array(pair("B", F.concat(F.lit("P"), F.col("n_nationkey").cast("string"))), pair("C", F.col("n_name")))).alias("_c"))
    name = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "Ville ").otherwise("T"), F.col("s_suppkey").cast("string"))
    rows = joined.select("file", "sheet_ord", "sheet", (first + F.col("s_suppkey") + 1).cast("int").alias("row"), F.explode(F.array(pair("E", name), pair("G", F.col("s_suppkey")), pair("I", F.lit(7)))).alias("_c"))
    titles = at.select("file", "sheet_ord", "sheet").distinct().select("file", "sheet_ord", "sheet", F.lit(-1).alias("row"), F.explode(F.array(pair("C", F.lit("Province")), pair("E", F.lit("Town/Territory")))).alias("_c"))
    cells = heads.unionByName(rows).unionByName(titles).select("file", "sheet_ord", "sheet", "row", "_c.col", "_c.value")
    return workbook_entities(cells).drop("file", "sheet", "row")
