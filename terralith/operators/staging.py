"""Normalisation of staging rows of any source: prepare, classify, resolve parents, validate, match, summarise.

staging: ord, id, raw_name, raw_code, type_hint, parent_code, zone_code, province_name, territory_name,
geometry_type, geometry (GeoJSON text); level and admin_level, if there, may name the type too
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.text import blank_to_null, compact_code, staging_key
from terralith.operators.classify import staging_type
from terralith.operators.hierarchy import ALLOWED_PARENTS, parent_rules, resolve_staging_parents
from terralith.operators.match import candidate_pairs
from terralith.operators.quality import EXPECTED_COUNTS


def prepare(staging: DataFrame) -> DataFrame:
    """Names, codes and types normalised; parents resolved."""
    rows = staging.withColumn("name_key", staging_key("raw_name")).withColumn("code", compact_code("raw_code")).withColumn("parent_code", compact_code("parent_code"))
    candidates = F.transform(F.array_compact(F.array("name_key", *(c for c in ("type_hint", "level", "admin_level") if c in staging.columns))), lambda c: F.upper(c))
    kind = staging_type(candidates, blank_to_null("zone_code"), blank_to_null("province_name"), blank_to_null("territory_name"), F.col("geometry_type"))
    rows = rows.withColumn("entity_type", kind).withColumn("province_key", staging_key("province_name")).withColumn("territory_key", staging_key("territory_name"))
    return resolve_staging_parents(rows)


def issues(prepared: DataFrame) -> DataFrame:
    """(id, issue): EMPTY_NAME, MISSING_CODE, DUPLICATE_CODE, DUPLICATE_NAME (within a type), INVALID_GEOMETRY,
    MISSING_PARENT, ORPHAN_ENTITY, INVALID_HIERARCHY."""
    # rows without code or name are groups of their own, so that they don't meet in one task
    same_code = F.count("*").over(Window.partitionBy(F.coalesce("code", F.concat(F.lit("\0"), "id"))))
    same_name = F.count("*").over(Window.partitionBy("entity_type", F.when(F.col("name_key") == "", F.concat(F.lit("\0"), "id")).otherwise(F.col("name_key"))))
    rows = prepared.withColumn("_codes", same_code).withColumn("_names", same_name)
    parents = prepared.select(F.col("id").alias("_pid"), F.col("entity_type").alias("_ptype")).dropDuplicates(["_pid"])
    rows = rows.join(parents, F.col("parent_id") == F.col("_pid"), "left")
    allowed = parent_rules(prepared.sparkSession).select(F.col("child_type").alias("_child"), F.col("parent_type").alias("_allowed"))
    rows = rows.join(allowed, (F.col("entity_type") == F.col("_child")) & (F.col("_ptype") == F.col("_allowed")), "left")
    needs = F.col("entity_type").isin(*ALLOWED_PARENTS)
    none = F.col("parent_id").isNull()
    bad_geometry = F.col("geometry").isNotNull() & (F.col("geometry_type").isNull() | F.get_json_object("geometry", "$.coordinates").isNull())
    found = F.array_compact(
        F.array(
            F.when(F.col("name_key") == "", "EMPTY_NAME"),
            F.when(F.col("code").isNull(), "MISSING_CODE"),
            F.when(F.col("code").isNotNull() & (F.col("_codes") > 1), "DUPLICATE_CODE"),
            F.when((F.col("name_key") != "") & (F.col("_names") > 1), "DUPLICATE_NAME"),
            F.when(bad_geometry, "INVALID_GEOMETRY"),
            F.when(needs & (none | F.col("_pid").isNull()), "MISSING_PARENT"),
            F.when(needs & none, "ORPHAN_ENTITY"),
            F.when(needs & F.col("_pid").isNotNull() & F.col("_allowed").isNull(), "INVALID_HIERARCHY"),
        )
    )
    return rows.select("id", F.explode(found).alias("issue"))


def count_gaps(prepared: DataFrame, expected: dict[str, int] = EXPECTED_COUNTS) -> DataFrame:
    """(level, expected, actual) of the levels whose number isn't the expected one."""
    wanted = prepared.sparkSession.createDataFrame(list(expected.items()), "level string, expected int")
    counts = prepared.groupBy("entity_type").agg(F.count("*").alias("_n"))
    joined = wanted.join(counts, F.col("level") == F.col("entity_type"), "left")
    return joined.select("level", "expected", F.coalesce("_n", F.lit(0)).alias("actual")).filter("expected <> actual")


def matches(prepared: DataFrame) -> DataFrame:
    return candidate_pairs(prepared.select("ord", "id", "entity_type", "code", F.col("name_key").alias("name"), F.col("parent_id").alias("parent")))


def statistics(prepared: DataFrame) -> DataFrame:
    """One row: entities, completeness rate over name, code, type and parent, errors, error rate, quality score."""
    parent = F.coalesce("parent_id", "parent_code").isNotNull()
    filled = sum((F.count_if(c) for c in (F.col("name_key") != "", F.col("code").isNotNull(), F.col("entity_type") != "unknown", parent)), F.lit(0))
    one = prepared.agg(F.count("*").alias("entities"), filled.alias("_filled")).withColumn("_j", F.lit(1))
    errors = issues(prepared).agg(F.count("*").alias("errors")).withColumn("_j", F.lit(1))
    rate = F.coalesce(F.try_divide("_filled", 4 * F.col("entities")), F.lit(1.0))
    score = F.greatest(F.lit(0.0), F.round(rate * 100 - F.least("errors", F.lit(100)), 2))
    return one.join(errors, "_j").select("entities", F.round(rate, 4).alias("completeness_rate"), "errors", F.coalesce(F.round(F.try_divide("errors", "entities"), 4), F.lit(0.0)).alias("error_rate"), score.alias("quality_score"))


#: Other names of levels (fixed values).
LEVEL_ALIASES = {"adm0": "pays", "adm1": "province", "adm2": "territoire", "adm3": "groupement", "adm4": "village", "city": "ville"}
#: Depth of levels (fixed values).
LEVEL_ORDER = {"pays": 0, "province": 1, "ville": 2, "territoire": 2, "commune": 3, "secteur": 3, "chefferie": 3, "groupement": 4, "quartier": 4, "village": 5, "localite": 6, "unknown": 99}


def level_of(c):
    """A level's name from itself or an alias; 'unknown' otherwise."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    names = F.create_map(*(F.lit(x) for pair in (LEVEL_ALIASES | {k: k for k in LEVEL_ORDER}).items() for x in pair))
    return F.coalesce(F.try_element_at(names, text), F.lit("unknown"))


def level_order(c):
    order = F.create_map(*(F.lit(x) for pair in LEVEL_ORDER.items() for x in pair))
    return F.coalesce(F.try_element_at(order, level_of(c)), F.lit(99))
