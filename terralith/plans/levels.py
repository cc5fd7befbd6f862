"""Queries of the referentials' levels over placemarks made from tables, of texts and of staging rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import text as t
from terralith.operators import decision as op
from terralith.operators import knowledge, staging
from terralith.plans import referentials as r
from terralith.plans.audits import _ISSUES_SQL, prepared_customers
from terralith.plans.tables import localities, read
from terralith.sources import kml

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


ZONES = ["Zone Nord", "ZONE OUEST", "zone centre", "Zone Sud", "ZONE EST"]
_CODES = "['ND', 'OT', 'CE', 'SD', 'ET']"


def _ext(**values: Column) -> Column:
    """Extended data of a placemark; null values have no entry."""
    return F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in values.items())))


def _marks(rows: DataFrame, path: Column, name: Column, ext: Column, point: Column) -> DataFrame:
    """Placemarks of rows with an `ord`."""
    none = F.lit(None).cast("string")
    return rows.select(F.lit("f").alias("file"), "ord", path.alias("path"), name.alias("name"), none.alias("description"), ext.alias("ext"), F.when(point.isNotNull(), "Point").alias("geometry_type"), point.alias("coordinates"))


def _territory_marks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as placemarks: six and seven deep under Territoire(s), five deep, and in another folder."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("ord", k)
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("r_regionkey") % 5).cast("int"))
    last = F.when(k % 4 == 2, "Communes").when(k % 8 == 0, "territoires").otherwise("Territoire")
    path = F.concat(F.when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("Doc"))), F.array(F.lit("ZONES"), zone, F.lit("Provinces"), F.col("n_name")), F.when(k % 4 == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), F.array(last))
    ext = _ext(TYPE=F.when(k % 3 == 0, "Communes").otherwise("Territoire"), PROVINCE=F.when(k % 5 == 0, "AUTRE").when(k % 5 == 1, F.lower("n_name")), ZONE=F.when(k % 7 == 0, "nord"), CODE_INS=F.concat(k.cast("string"), F.lit(".000")))
    return _marks(rows, path, F.when(k % 11 > 0, F.col("c_name")).otherwise(" "), ext, F.when(k % 6 > 0, "[20.5, -3.25]"))


_TERRITORY_SQL = f"""m AS (SELECT c_custkey AS k, c_name, n_name, {_CODES}[r_regionkey % 5 + 1] AS zone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_TERRITORY_SQL}, i AS (SELECT *, k % 7 = 0 AND zone <> 'ND' AS bad_zone, k % 5 = 0 AS bad_province FROM m WHERE k % 4 IN (0, 3))
SELECT k AS ord, CASE WHEN k % 11 > 0 THEN c_name END AS nom, zone, n_name AS province, CASE WHEN k % 3 = 0 THEN 'Communes' ELSE 'Territoire' END AS type, CAST(k AS VARCHAR) AS code,
  concat_ws(',', CASE WHEN bad_zone THEN 'zone' END, CASE WHEN bad_province THEN 'province' END) AS incoherences,
  greatest(0.0, 100.0 - CASE WHEN k % 6 = 0 THEN 40 ELSE 0 END - least(40, 15 * (CAST(bad_zone AS INT) + CAST(bad_province AS INT)))) AS score FROM i""")
def territory_referential(spark: SparkSession, d: str) -> DataFrame:
    """Territories lie at least six deep in Territoire(s); attributes that gainsay the path are inconsistencies."""
    rows = r.territories(_territory_marks(spark, d))
    return rows.select("ord", "nom", "zone", "province", "type", "code", F.array_join("incoherences", ",").alias("incoherences"), "score")


@query(f"""WITH {_TERRITORY_SQL} SELECT k AS ord, c_name AS nom, zone, n_name AS province, k % 6 > 0 AS geometrie_valide, CASE WHEN k % 6 > 0 THEN 100.0 ELSE 60.0 END AS score FROM m WHERE k % 4 = 0 AND k % 3 = 0 AND k % 11 > 0""")
def city_referential(spark: SparkSession, d: str) -> DataFrame:
    """Cities are named communes exactly six deep in Territoire(s)."""
    return r.cities(_territory_marks(spark, d)).select("ord", "nom", "zone", "province", "geometrie_valide", "score")


@query(f"""WITH {_TERRITORY_SQL} SELECT k AS ord, zone AS zone_code, n_name AS province, CASE WHEN k % 2 = 0 THEN 'Nord ' || n_name END AS des_collectivites, CASE WHEN k % 2 = 0 THEN 'Collectivités Nord ' || n_name ELSE n_name END AS dossier,
  CASE zone WHEN 'ND' THEN 'Nord' WHEN 'OT' THEN 'Ouest' WHEN 'CE' THEN 'Centre' WHEN 'SD' THEN 'Sud' ELSE 'Est' END AS libelle FROM m""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """What a folder path tells: zone, its label, province after the marker, province of the collectivities."""
    marks = _territory_marks(spark, d)
    k = F.col("ord")
    path = F.concat(F.slice("path", 1, F.array_position("path", "Provinces").cast("int") + 1), F.when(k % 2 == 0, F.array(F.concat(F.lit("Collectivités Nord "), F.element_at("path", F.array_position("path", "Provinces").cast("int") + 1)))).otherwise(F.array().cast("array<string>")))
    rows = marks.select("ord", path.alias("p"))
    zone = t.zone_code(kml.zone_of_path(F.col("p")))
    return rows.select("ord", zone.alias("zone_code"), kml.province_after_marker(F.col("p")).alias("province"), kml.province_of_collectivities(F.col("p")).alias("des_collectivites"), kml.innermost_folder(F.col("p")).alias("dossier"), t.zone_label(zone).alias("libelle"))


def _collectivity_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations as collectivities of territories that are named after their regions."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    return nation.select(k.cast("long").alias("ord"), F.col("n_name").alias("nom"), F.col("r_name").alias("territoire"), F.lit("Kasai").alias("province"), F.lit("ND").alias("zone"), (100000 + k).cast("string").alias("code"))


_GROUPING_SQL = """g AS (SELECT c_custkey AS k, c_name, c_nationkey, n_name, r_name, c_custkey % 4 AS q FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _grouping_marks(spark: SparkSession, d: str) -> DataFrame:
    """Customers as groupings: found by code (0), by names (1), by code against what they say (2), not at all (3)."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("ord", k)
    q = k % 4
    code = F.when(q.isin(0, 2), F.concat((100000 + F.col("c_nationkey")).cast("string"), F.lit("07.0"))).when(q == 3, "99")
    said = F.when(q.isin(0, 1), F.lower("n_name")).when(q == 2, "Autre")
    return _marks(rows, F.array(F.lit("Doc")), F.col("c_name"), _ext(CODE_GRPT=code, COLLECTIV=said, TERRITOIRE=F.when(q == 2, "Loin").otherwise(F.col("r_name"))), F.lit("[20.5, -3.25]"))


@query(f"""WITH {_GROUPING_SQL} SELECT k AS ord, c_name AS nom, CASE WHEN q < 3 THEN n_name END AS collectivite, CASE q WHEN 1 THEN 'nom' WHEN 3 THEN 'non rattaché' ELSE 'code' END AS resolution,
  CASE WHEN q = 2 THEN 'COLLECTIV source=' || chr(39) || 'Autre' || chr(39) || ' parent=' || chr(39) || n_name || chr(39) || '|TERRITOIRE source=' || chr(39) || 'Loin' || chr(39) || ' parent=' || chr(39) || r_name || chr(39) ELSE '' END AS incoherences FROM g""")
def grouping_referential(spark: SparkSession, d: str) -> DataFrame:
    """Groupings find their collectivity by code, else by names; what they say against it is an inconsistency."""
    rows = r.groupings(_grouping_marks(spark, d), _collectivity_rows(spark, d))
    return rows.select("ord", "nom", "collectivite", "resolution", F.array_join("incoherences", "|").alias("incoherences"))


@query("""WITH l AS (SELECT c_custkey AS k, c_name, n_name, r_name, c_custkey % 6 AS q FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT k AS ord, CASE q WHEN 0 THEN 'CODE_GRPT' WHEN 1 THEN 'noms groupement' WHEN 2 THEN 'PCODE' WHEN 3 THEN 'noms collectivite' WHEN 4 THEN 'nom territoire' ELSE 'non rattaché' END AS resolution,
  CASE WHEN q < 2 THEN 'groupement' WHEN q < 4 THEN 'collectivite' WHEN q = 4 THEN 'territoire' END AS parent_level, CASE WHEN q < 2 THEN 'G ' || n_name END AS groupement, CASE WHEN q < 4 THEN n_name END AS collectivite, CASE WHEN q < 5 THEN r_name END AS territoire FROM l""")
def locality_referential(spark: SparkSession, d: str) -> DataFrame:
    """Localities through the five rules in turn, and those that none attaches."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, q = F.col("c_custkey"), F.col("c_custkey") % 6
    rows = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("ord", k)
    six = (100000 + F.col("c_nationkey")).cast("string")
    ext = _ext(
        CODE_GRPT=F.when(q == 0, F.concat(six, F.lit("07"))), PCODE=F.when(q == 2, F.concat(six, F.lit("0042"))),
        GROUPEMENT=F.when(q == 1, F.concat(F.lit("g "), F.lower("n_name"))), COLLECTIV=F.when(q.isin(1, 3), F.col("n_name")), TERRITOIRE=F.when(q.isin(1, 3, 4), F.lower("r_name")),
    )
    marks = _marks(rows, F.array(F.lit("Doc")), F.col("c_name"), ext, F.lit("[20.5, -3.25]"))
    c = _collectivity_rows(spark, d)
    g = c.select("ord", F.concat(F.lit("G "), "nom").alias("nom"), F.col("nom").alias("collectivite"), "territoire", "province", "zone", F.concat("code", F.lit("07")).alias("code"))
    p = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("nom"), F.lit("Kasai").alias("province"), F.lit("ND").alias("zone"))
    return r.localities(marks, g, c, p).select("ord", "resolution", "parent_level", "groupement", "collectivite", "territoire")


@query(f"""WITH {_ISSUES_SQL}, n AS (SELECT CAST(count(*) AS BIGINT) AS entities, sum(CAST(name_key <> '' AS INT) + CAST(code IS NOT NULL AS INT) + 1 + CAST(parent_id IS NOT NULL AS INT)) AS filled,
  sum(CAST(name_key = '' AS INT) + CAST(code IS NULL AS INT) + CAST(code IS NOT NULL AND codes > 1 AS INT) + CAST(name_key <> '' AND names > 1 AS INT) + CAST(k % 3 = 1 AS INT) + CAST(needs AND ptype IS NULL AS INT) + CAST(needs AND parent_id IS NULL AS INT)
    + CAST(ptype IS NOT NULL AND needs AND NOT (entity_type = 'village' AND ptype = 'groupement' OR entity_type = 'groupement' AND ptype = 'secteur') AS INT)) AS errors FROM j)
SELECT entities, round(filled / (4.0::DOUBLE * entities), 4) AS completeness_rate, CAST(errors AS BIGINT) AS errors, round(errors / CAST(entities AS DOUBLE), 4) AS error_rate, greatest(0.0, round(filled / (4.0::DOUBLE * entities) * 100 - least(errors, 100), 2)) AS quality_score FROM n""")
def staging_statistics(spark: SparkSession, d: str) -> DataFrame:
    """One row on prepared staging rows: completeness, errors, score."""
    rows = prepared_customers(spark, d).withColumn("parent_code", F.lit(None).cast("string"))
    return staging.statistics(rows)


@query("""SELECT p_partkey, ['pays', 'province', 'territoire', 'groupement', 'village', 'ville', 'localite', 'unknown', 'unknown'][p_size % 9 + 1] AS niveau, CAST([0, 1, 2, 4, 5, 2, 6, 99, 99][p_size % 9 + 1] AS INTEGER) AS rang FROM part""")
def level_names(spark: SparkSession, d: str) -> DataFrame:
    """Levels by name or alias, in any case, and their depth."""
    said = F.get(F.array(*map(F.lit, ["ADM0", " adm1 ", "adm2", "Adm3", "adm4", "city", "Localite", "autre", None])), (F.col("p_size") % 9).cast("int"))
    return read(spark, d, "part").select("p_partkey", staging.level_of(said).alias("niveau"), staging.level_order(said).cast("int").alias("rang"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 1 THEN p_brand END, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS VARCHAR) END, p_name) AS vrai, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE CAST(p_size % 5 AS VARCHAR) END AS present FROM part""")
def first_truthy_fields(spark: SparkSession, d: str) -> DataFrame:
    """The first value that is neither null, empty nor zero, beside the first that isn't null."""
    one = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    rows = read(spark, d, "part").select("p_partkey", "p_name", one.alias("a"), (F.col("p_size") % 5).alias("b"))
    return rows.select("p_partkey", t.first_truthy("a", "b", "p_name").alias("vrai"), F.coalesce("a", F.col("b").cast("string"), "p_name").alias("present"))


@query("""WITH l AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal > 5000 THEN true END AS c4 FROM customer)
SELECT '4G' AS generation, CAST(count_if(c4) AS BIGINT) AS n FROM l UNION ALL SELECT '9G', CAST(count(*) AS BIGINT) FROM l UNION ALL SELECT '', CAST(count(*) AS BIGINT) FROM l""")
def coverage_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """A generation names its column; an unknown one is no filter."""
    rows, out = localities(spark, d), None
    for generation in ("4G", "9G", None):
        part = op.all_of(rows, op.coverage_filter(generation)).agg(F.lit(generation or "").alias("generation"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH n AS (SELECT count(*) AS n FROM supplier), p AS (SELECT greatest(1, CAST(ceil(n / 7.0) AS BIGINT)) AS last FROM n)
SELECT s_suppkey, s_name FROM (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name, s_suppkey) AS k FROM supplier), p WHERE k > (last - 1) * 7 AND k <= last * 7""")
def page_beyond_the_last(spark: SparkSession, d: str) -> DataFrame:
    """A page asked for beyond the end is the last one."""
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name")
    pages = op.Pages(rows, ["s_name", "s_suppkey"])
    return pages.at((op.clamped_page(pages.total, 7, 10**6) - 1) * 7, 7)


@query("""SELECT n_name AS entity, 'Province' AS entity_type, CASE WHEN n_nationkey % 2 = 0 THEN 'Documents' ELSE 'Présentation' END AS fields, CASE WHEN n_nationkey % 2 = 0 THEN 'Rapport ' || n_name ELSE 'Donnée non encore renseignée' END AS excerpt,
  CAST(CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 0 END AS INTEGER) AS completeness FROM nation WHERE contains(lower(n_name), 'an')""")
def knowledge_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities that a text occurs in, by title or value, the sections that have it, and an excerpt."""
    value = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Rapport "), F.col("n_name"))).otherwise(" ")
    values = read(spark, d, "nation").select(F.col("n_name").alias("entity"), F.lit("Province").alias("entity_type"), F.lit("documents").alias("section"), value.alias("value"))
    found = knowledge.search(values, " AN ")
    return found.select("entity", "entity_type", F.array_join("matched_fields", ",").alias("fields"), "excerpt", "completeness")
