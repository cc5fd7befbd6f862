"""Resolution, classification, validation and matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.text import alnum_key, staging_key, xml_escape
from terralith.operators.attach import Level, attached, child_counts, ids_under_parents, kept_nodes, unattached
from terralith.operators import classify as c
from terralith.operators import geometry as g
from terralith.operators.hierarchy import resolve_staging_parents
from terralith.operators.match import candidate_pairs, merge_proposals
from terralith.operators.resolve import Rule, ordered_fallback_join
from terralith.operators.windows import keep_last
from terralith.plans.tables import read
from terralith.sources import kml

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 700 AS VARCHAR) AS k, substr(p_brand, 1, 7) AS b FROM part),
s AS (SELECT s_suppkey AS ord, CAST(s_suppkey AS VARCHAR) AS k, 'Brand#' || CAST(s_suppkey % 4 + 1 AS VARCHAR) AS b, s_name AS parent_name FROM supplier),
a AS (SELECT k, arg_max(parent_name, ord) AS parent_name FROM s GROUP BY k), b AS (SELECT b, arg_min(parent_name, ord) AS parent_name FROM s GROUP BY b)
SELECT p_partkey, coalesce(a.parent_name, b.parent_name) AS parent_name, CASE WHEN a.k IS NOT NULL THEN 'code' WHEN b.b IS NOT NULL THEN 'marque' ELSE 'non rattaché' END AS resolution,
  CASE WHEN a.k IS NOT NULL THEN 'fournisseur' WHEN b.b IS NOT NULL THEN 'famille' END AS parent_level FROM p LEFT JOIN a ON p.k = a.k LEFT JOIN b ON p.b = b.b""", "ordered_fallback_join")
def ordered_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Parts find a supplier by code, else by the family of their brand."""
    suppliers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("k"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 4 + 1).cast("string")).alias("b"), F.col("s_name").alias("parent_name"))
    rules = [
        Rule("code", ((F.col("p_partkey") % 700).cast("string"),), suppliers, ("k",), "fournisseur", "last"),
        Rule("marque", (F.substring("p_brand", 1, 7),), suppliers, ("b",), "famille", "first"),
    ]
    return ordered_fallback_join(read(spark, d, "part").select("p_partkey", "p_brand"), rules, ["parent_name"]).drop("p_brand")


@query("""WITH k AS (SELECT substr(c_name, length(c_name) - 2, 2) AS prefix, arg_max(c_custkey, c_custkey) AS last_id FROM customer GROUP BY 1)
SELECT o_orderkey, prefix, last_id FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS p FROM orders) LEFT JOIN k ON p = prefix""")
def prefix_lookup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Orders find the last customer with their two-digit prefix."""
    keyed = read(spark, d, "customer").select(F.expr("substring(c_name, length(c_name) - 2, 2)").alias("prefix"), F.col("c_custkey").alias("last_id"))
    index = keep_last(keyed, ["prefix"], "last_id")
    orders = read(spark, d, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0").alias("_p"))
    return orders.join(index, F.col("_p") == F.col("prefix"), "left").select("o_orderkey", "prefix", "last_id")


@query("""WITH n AS (SELECT regexp_replace(upper(trim(n_name)), '[^A-Z0-9]', '', 'g') AS k, CAST(n_nationkey AS VARCHAR) AS code, n_name FROM nation),
q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(replace(n_name, ' ', '-')) END AS asked_name, CASE WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey AS VARCHAR) END AS asked_code FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(a.n_name, b.n_name) AS province, CASE WHEN a.k IS NOT NULL THEN 'nom' WHEN b.code IS NOT NULL THEN 'code' ELSE 'non rattaché' END AS resolution
FROM q LEFT JOIN n a ON regexp_replace(upper(trim(asked_name)), '[^A-Z0-9]', '', 'g') = a.k LEFT JOIN n b ON asked_code = b.code""")
def nomenclature_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Customers find their nation by normalised name, else by code."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), alnum_key("n_name").alias("k"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("province"))
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    turn = F.col("c_custkey") % 3
    asked = joined.select("c_custkey", F.when(turn == 0, F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("asked_name"), F.when(turn == 1, F.col("c_nationkey").cast("string")).alias("asked_code"))
    rules = [Rule("nom", (alnum_key("asked_name"),), nation, ("k",), "province"), Rule("code", (F.col("asked_code"),), nation, ("code",), "province")]
    return ordered_fallback_join(asked, rules, ["province"]).select("c_custkey", "province", "resolution")


@query("""SELECT p_partkey, CASE WHEN contains(t, 'province') THEN 'Province' WHEN contains(t, 'station') OR contains(t, 'site') THEN 'Site' WHEN contains(t, 'ville') THEN 'Ville' ELSE 'Inconnu' END AS class
FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, CASE p_size % 5 WHEN 0 THEN 'PROVINCE' WHEN 1 THEN 'station site' WHEN 2 THEN 'Ville' END)) AS t FROM part)""")
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    """Parts, a word of each of several classes added by size, through the ordered feature rules."""
    return _features(spark, d).select("p_partkey", c.first_rule(F.col("t"), c.FEATURE_RULES, "Inconnu").alias("class"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 5
    word = F.when(size == 0, "PROVINCE").when(size == 1, "station site").when(size == 2, "Ville")
    return read(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type", word)).alias("t"))


@query("""SELECT p_partkey, CASE s WHEN 0 THEN 0.55 WHEN 1 THEN 0.7 WHEN 2 THEN 0.55 ELSE 0.0 END::DOUBLE AS confidence, CASE s WHEN 0 THEN 'province' WHEN 1 THEN 'site,station' WHEN 2 THEN 'ville' ELSE '' END AS terms
FROM (SELECT p_partkey, p_size % 5 AS s FROM part)""")
def classify_confidence(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _features(spark, d).select("p_partkey", F.round(c.confidence(t, c.FEATURE_RULES), 2).alias("confidence"), F.array_join(c.matched_terms(t, c.FEATURE_RULES), ",").alias("terms"))


@query("""SELECT p_partkey, CASE s WHEN 0 THEN 'Référentiel administratif,Province' WHEN 1 THEN 'Télécommunications,Sites' WHEN 2 THEN 'Statistiques,KPI' WHEN 3 THEN 'Télécommunications,Backbone' ELSE 'Autres' END AS tags FROM (SELECT p_partkey, p_size % 5 AS s FROM part)""")
def category_tags(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 5
    words = F.when(size == 0, "province").when(size == 1, "site").when(size == 2, "kpi").when(size == 3, "fibre").otherwise("xyz")
    return read(spark, d, "part").select("p_partkey", F.array_join(c.tags(words), ",").alias("tags"))


@query("""WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '4' WHEN 1 THEN '7' WHEN 2 THEN '456' WHEN 3 THEN 'x' WHEN 4 THEN '' ELSE '0' END AS code, CASE WHEN p_partkey % 10 = 0 THEN 'quartier nord' ELSE 'nom' END AS h FROM part)
SELECT p_partkey, CASE WHEN contains(h, 'quartier') THEN 'Quartier' ELSE CASE code WHEN '4' THEN 'Cité' WHEN '7' THEN 'Camp' WHEN '456' THEN 'Cité' WHEN '0' THEN 'Village' ELSE 'Autre' END END AS kind,
  CASE WHEN contains(h, 'quartier') THEN 'mot-cle quartier' ELSE CASE WHEN code IN ('4', '7', '0') THEN 'code TYPE=' || code WHEN code = '456' THEN 'code TYPE composite=456' WHEN code = '' THEN 'code TYPE non documente=vide' ELSE 'code TYPE non documente=' || code END END AS reason FROM s""")
def locality_types(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 6
    code = F.when(size == 0, "4").when(size == 1, "7").when(size == 2, "456").when(size == 3, "x").when(size == 4, "").otherwise("0")
    haystack = F.when(F.col("p_partkey") % 10 == 0, "quartier nord").otherwise("nom")
    kind, reason = c.locality_type(F.col("h"), F.col("code"))
    return read(spark, d, "part").select("p_partkey", code.alias("code"), haystack.alias("h")).select("p_partkey", kind.alias("kind"), reason.alias("reason"))


def _staging(spark: SparkSession, d: str) -> DataFrame:
    """Nations as provinces and customers as territories of them; some name no province, some an unknown code."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("province").alias("entity_type"), F.concat(F.lit("P"), "n_nationkey").alias("code"), F.lit(None).cast("string").alias("parent_code"), staging_key("n_name").alias("name_key"), F.lit("").alias("province_key"), F.lit("").alias("territory_key"))
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    third = F.col("c_custkey") % 4
    customer = joined.select((F.col("c_custkey") + 1000).alias("ord"), F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit("territoire").alias("entity_type"), F.when(third != 3, F.concat(F.lit("T"), "c_custkey")).alias("code"), F.when(third == 0, F.concat(F.lit("P"), "c_nationkey")).when(third == 1, "P999").alias("parent_code"), F.when(F.col("c_custkey") % 50 == 0, "").otherwise(staging_key("c_name")).alias("name_key"), F.when(third == 2, staging_key("n_name")).otherwise("").alias("province_key"), F.lit("").alias("territory_key"))
    return nation.unionByName(customer)


_STAGING_SQL = """s AS (SELECT c_custkey, c_nationkey, c_custkey % 4 AS q, 'C' || c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'x' END AS name_key FROM customer),
r AS (SELECT *, CASE WHEN q IN (0, 2) THEN 'N' || c_nationkey END AS parent_id FROM s)"""


@query(f"WITH {_STAGING_SQL} SELECT id, parent_id FROM r UNION ALL SELECT 'N' || n_nationkey, NULL FROM nation")
def parent_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve_staging_parents(_staging(spark, d)).select("id", "parent_id")


@query(f"""WITH {_STAGING_SQL} SELECT id, 'EMPTY_NAME' AS issue FROM r WHERE name_key = '' UNION ALL SELECT id, 'MISSING_CODE' FROM r WHERE q = 3
UNION ALL SELECT id, 'ORPHAN_ENTITY' FROM r WHERE parent_id IS NULL UNION ALL SELECT id, 'MISSING_PARENT' FROM r WHERE q = 1 UNION ALL SELECT 'N' || n_nationkey, 'ORPHAN_ENTITY' FROM nation""")
def parent_validation(spark: SparkSession, d: str) -> DataFrame:
    """Issues of staging rows, one row each."""
    resolved = resolve_staging_parents(_staging(spark, d))
    orphan = F.col("parent_id").isNull()
    issues = F.array_compact(F.array(F.when(F.col("name_key") == "", "EMPTY_NAME"), F.when(F.col("code").isNull(), "MISSING_CODE"), F.when(orphan, "ORPHAN_ENTITY"), F.when(orphan & F.col("parent_code").isNotNull(), "MISSING_PARENT")))
    return resolved.select("id", F.explode(issues).alias("issue"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    return part.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.lit("part").alias("entity_type"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("parent"))


@query("""WITH e AS (SELECT p_partkey AS id, concat_ws('/', p_brand, p_type, CAST(p_size AS VARCHAR)) AS code, p_name AS name FROM part)
SELECT a.id AS left_id, b.id AS right_id FROM e a JOIN e b ON a.code = b.code AND a.id < b.id""")
def match_candidates_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with equal codes: each scores 0.75 at least (code and parent), so the similarity of names never decides."""
    return candidate_pairs(_entities(spark, d)).select("left_id", "right_id")


@query(None)
def merge_proposal_rows(spark: SparkSession, d: str) -> DataFrame:
    """Proposals with confidence by similarity of names."""
    return merge_proposals(candidate_pairs(_entities(spark, d), joined=True))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, replace(CAST(round(l_discount * 2000 - 100, 1) AS VARCHAR), '.', ',') AS lat, CAST(round(l_tax * 3000, 1) AS VARCHAR) AS lon FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(replace(lat, ',', '.') AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(replace(lon, ',', '.') AS DOUBLE) BETWEEN -180 AND 180, false) AS valid FROM t""")
def coordinate_validation(spark: SparkSession, d: str) -> DataFrame:
    from terralith.functions.text import lenient_float

    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.replace(F.round(F.col("l_discount") * 2000 - 100, 1).cast("string"), F.lit("."), F.lit(",")).alias("lat"), F.round(F.col("l_tax") * 3000, 1).cast("string").alias("lon"))
    return rows.select("l_orderkey", "l_linenumber", g.valid_lon_lat(lenient_float("lon"), lenient_float("lat")).alias("valid"))


@query("""WITH n AS (SELECT n_nationkey, n_name, n_nationkey * 3 % 40 AS w FROM nation)
SELECT n_nationkey, n_name, CASE WHEN w < 1 THEN false ELSE true END AS valid, CAST(5 AS INTEGER) AS points, CAST(w AS DOUBLE) AS first_lon FROM n""")
def ring_validity(spark: SparkSession, d: str) -> DataFrame:
    """Squares written as coordinate text; those of width 0 are left open."""
    w = F.col("n_nationkey") * 3 % 40
    text = F.concat(w, F.lit(",0,7 "), w, F.lit(",1 0,1 0,0 "), F.when(w < 1, F.lit("5")).otherwise(w.cast("string")), F.lit(",0"))
    points = g.parse_coordinates(F.col("t"))
    rows = read(spark, d, "nation").select("n_nationkey", "n_name", text.alias("t")).withColumn("p", points)
    return rows.select("n_nationkey", "n_name", g.ring_closed(F.col("p")).alias("valid"), F.size("p").alias("points"), g.representative(g.flat(F.col("p")))[0].alias("first_lon"))


@query("""SELECT c_custkey, '{"type":"Feature","properties":{"nom":"' || c_name || '","activite":"' || c_mktsegment || '"},"geometry":{"type":"Point","coordinates":[' || CAST(c_custkey % 360 - 180 AS VARCHAR) || '.0,' || CAST(c_nationkey * 3 - 40 AS VARCHAR) || '.0]}}' AS feature FROM customer""")
def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer")
    lon, lat = (F.col("c_custkey") % 360 - 180).cast("double"), (F.col("c_nationkey") * 3 - 40).cast("double")
    return rows.select("c_custkey", g.point_feature(lon, lat, nom=F.col("c_name"), activite=F.col("c_mktsegment")).alias("feature"))


@query("""SELECT r_name AS folder, n_name AS name, CAST(n_nationkey AS VARCHAR) AS code, 'Point' AS geometry_type, '[' || CAST(n_nationkey AS VARCHAR) || '.0, 1.5]' AS coordinates,
  CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS BIGINT) AS ord FROM nation JOIN region ON n_regionkey = r_regionkey""")
def kmz_placemarks(spark: SparkSession, d: str) -> DataFrame:
    """One KML document a region, written from its nations and read back as placemarks."""
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mark = F.format_string('<Placemark><name>%s</name><ExtendedData><Data name="CODE"><value>%d</value></Data></ExtendedData><Point><coordinates>%d,1.5</coordinates></Point></Placemark>', xml_escape("n_name"), "n_nationkey", "n_nationkey")
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", mark.alias("mark")))), lambda x: x["mark"]), "")
    documents = nations.groupBy("r_name").agg(marks.alias("_marks"))
    head = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>%s</name>%s</Folder></Document></kml>'
    files = documents.select(F.concat("r_name", F.lit(".kml")).alias("path"), F.encode(F.format_string(head, xml_escape("r_name"), "_marks"), "UTF-8").alias("content"))
    rows = files.mapInPandas(kml.placemarks, kml.SCHEMA)
    return rows.select(kml.innermost_folder(F.col("path")).alias("folder"), "name", kml.extended_map(F.col("ext"))["CODE"].alias("code"), "geometry_type", "coordinates", "ord")


_ATTACH_SQL = """c AS (
  SELECT c_custkey AS id, c_name AS nom, r_name AS zone, CASE WHEN c_custkey % 11 = 0 THEN 'Nulle part' ELSE n_name END AS province, c_mktsegment AS collectivite,
         CASE WHEN c_custkey % 5 > 0 THEN 'G' || CAST(c_custkey % 4 AS VARCHAR) END AS groupement
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), t AS (SELECT DISTINCT zone, n_name AS nom, CAST(n_nationkey AS BIGINT) AS id FROM c JOIN nation ON province = n_name),
k AS (SELECT zone, province, collectivite AS nom, min(id) AS id FROM c WHERE collectivite <> 'MACHINERY' AND province <> 'Nulle part' GROUP BY ALL),
g AS (SELECT zone, province, collectivite, groupement AS nom, min(id) AS id FROM c WHERE groupement IN ('G0', 'G1', 'G2') GROUP BY ALL),
g2 AS (SELECT g.* FROM g JOIN k ON g.zone = k.zone AND g.province = k.province AND g.collectivite = k.nom)"""


def _attach_levels(spark: SparkSession, d: str) -> tuple[DataFrame, list[Level]]:
    """Customers as localities that name a zone, a province, a collectivity and, most of them, a grouping; and the nodes
    they name: no collectivity of one segment, no grouping of one number, and provinces that aren't there."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    province = F.when(F.col("c_custkey") % 11 == 0, "Nulle part").otherwise(F.col("n_name"))
    group = F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("G"), (F.col("c_custkey") % 4).cast("string")))
    leaves = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"), F.col("r_name").alias("zone"), province.alias("province"), F.col("c_mktsegment").alias("collectivite"), group.alias("groupement"))
    top = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("nom"), F.col("r_name").alias("zone"))
    place = ["zone", "province", "collectivite"]
    middle = leaves.filter("collectivite <> 'MACHINERY'").groupBy(*place).agg(F.min("id").alias("id")).withColumnRenamed("collectivite", "nom")
    low = leaves.filter(F.col("groupement").isin("G0", "G1", "G2")).groupBy(*place, "groupement").agg(F.min("id").alias("id")).withColumnRenamed("groupement", "nom")
    return leaves, [Level("territoire", top, ("zone",)), Level("collectivite", middle, ("zone", "province")), Level("groupement", low, ("zone", "province", "collectivite"))]


_PLACES = {"groupement": ("zone", "province", "collectivite", "groupement"), "collectivite": ("zone", "province", "collectivite"), "territoire": ("zone", "province")}


@query(f"""WITH {_ATTACH_SQL}
SELECT c.id, CASE WHEN g2.id IS NOT NULL THEN 'groupement' WHEN k.id IS NOT NULL THEN 'collectivite' WHEN t.id IS NOT NULL THEN 'territoire' END AS parent_level, coalesce(g2.id, k.id, t.id) AS parent_id
FROM c LEFT JOIN g2 ON c.zone = g2.zone AND c.province = g2.province AND c.collectivite = g2.collectivite AND c.groupement = g2.nom
LEFT JOIN k ON c.zone = k.zone AND c.province = k.province AND c.collectivite = k.nom LEFT JOIN t ON c.zone = t.zone AND c.province = t.nom""")
def attach_by_path(spark: SparkSession, d: str) -> DataFrame:
    leaves, levels = _attach_levels(spark, d)
    return attached(leaves, kept_nodes(levels), _PLACES).select("id", "parent_level", "parent_id")


@query(f"""WITH {_ATTACH_SQL}
SELECT lower(zone || '|' || province) AS key, CAST(count(*) AS BIGINT) AS n FROM c WHERE province <> 'Nulle part' GROUP BY ALL
UNION ALL SELECT lower(c.zone || '|' || c.province || '|' || collectivite), CAST(count(*) AS BIGINT) FROM c JOIN k ON c.zone = k.zone AND c.province = k.province AND c.collectivite = k.nom GROUP BY ALL""")
def attached_child_counts(spark: SparkSession, d: str) -> DataFrame:
    """Localities below every territory and collectivity, wherever they hang under it."""
    leaves, levels = _attach_levels(spark, d)
    return child_counts(attached(leaves, kept_nodes(levels), _PLACES), 3).filter(F.size(F.split("key", r"\|")) > 1)


@query(f"""WITH {_ATTACH_SQL}
SELECT id, CASE WHEN groupement IS NOT NULL THEN 'groupement introuvable: ' || lower(zone || '|' || province || '|' || collectivite || '|' || groupement)
  ELSE 'collectivite introuvable: ' || lower(zone || '|' || province || '|' || collectivite) END AS reason FROM c WHERE province = 'Nulle part'""")
def unattached_report(spark: SparkSession, d: str) -> DataFrame:
    leaves, levels = _attach_levels(spark, d)
    return unattached(attached(leaves, kept_nodes(levels), _PLACES), _PLACES).select("id", "reason")


@query(f"""WITH {_ATTACH_SQL}
SELECT 'zone' AS level, CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id FROM region
UNION ALL SELECT 'territoire', CAST(n_nationkey AS BIGINT), CAST(r_regionkey AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'collectivite', k.id, t.id FROM k LEFT JOIN t ON k.zone = t.zone AND k.province = t.nom
UNION ALL SELECT 'collectivite', min(id), NULL FROM c WHERE collectivite <> 'MACHINERY' AND province = 'Nulle part' GROUP BY zone, collectivite
UNION ALL SELECT 'groupement', g.id, k.id FROM g LEFT JOIN k ON g.zone = k.zone AND g.province = k.province AND g.collectivite = k.nom""")
def ids_by_parent_path(spark: SparkSession, d: str) -> DataFrame:
    """Names to ids level by level: each segment's name occurs under every province."""
    _, levels = _attach_levels(spark, d)
    zones = Level("zone", read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("nom")))
    out = None
    for name, rows in ids_under_parents([zones, *levels]).items():
        part = rows.select(F.lit(name).alias("level"), "id", "parent_id")
        out = part if out is None else out.unionByName(part)
    return out
