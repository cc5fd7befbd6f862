"""Catalogue of a source: its folders with category, tags, module and quality, and the dictionary of its fields.

features: ord, folder, geometry_type, properties MAP<STRING, STRING>
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.operators.classify import CATEGORY_RULES, first_rule, tags
from terralith.operators.quality import first_of_each, value_kind

#: Module that a category belongs to (fixed values).
MODULES = {
    "Référentiel administratif": "Gestion des Référentiels",
    "Télécommunications": "Cartographie",
    "Sites": "Sites",
    "Planification": "Statistiques",
    "Couverture": "Cartographie",
    "Backbone": "Cartographie",
    "Population": "Statistiques",
    "Statistiques": "Statistiques",
    "Documents": "Gestion des Référentiels",
    "Photos": "Gestion des Référentiels",
}


def folders(features: DataFrame) -> DataFrame:
    """One row a folder: objects, attributes, geometry types, category, tags, module, quality.

    quality: 40 without attributes, else 0.9 of the share of filled attribute values in percent, and 10 if any object
    has a geometry, 100 at most.
    """
    filled = F.map_filter("properties", lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    rows = features.withColumn("_filled", F.size(filled))
    attributes = rows.select("folder", F.explode(F.map_keys("properties")).alias("_a")).groupBy("folder").agg(F.array_sort(F.collect_set("_a")).alias("attributes")).withColumnRenamed("folder", "_folder")
    base = rows.groupBy("folder").agg(F.count("*").alias("object_count"), F.array_sort(F.collect_set("geometry_type")).alias("geometry_types"), F.sum("_filled").alias("_sum"), F.count("geometry_type").alias("_with"))
    both = base.join(attributes, F.col("folder").eqNullSafe(F.col("_folder")), "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    text = F.lower(F.concat_ws(" ", "folder", F.array_join("attributes", " ")))
    module = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MODULES.items() for x in pair)), F.col("category")), F.lit("Dashboard"))
    share = F.try_divide(100.0 * F.col("_sum"), F.col("object_count") * F.size("attributes"))
    quality = F.when(F.size("attributes") == 0, 40.0).otherwise(F.round(F.least(F.lit(100.0), share * 0.9 + F.when(F.col("_with") > 0, 10.0).otherwise(0.0)), 2))
    out = both.withColumn("category", first_rule(text, CATEGORY_RULES, "Autres")).withColumn("tags", tags(text))
    return out.select("folder", "object_count", "attributes", "geometry_types", "category", "tags", module.alias("module"), quality.alias("quality"))


def dictionary(features: DataFrame, examples: int = 10) -> DataFrame:
    """One row a field: values, distinct values, blanks, the first value, kind, and the first distinct values."""
    pairs = features.select("ord", F.explode(F.map_entries("properties")).alias("_p")).select("ord", F.col("_p.key").alias("field"), F.nullif(F.trim(F.col("_p.value")), F.lit("")).alias("value"))
    per = pairs.groupBy("field", "value").agg(F.count("*").alias("_n"), F.min("ord").alias("_first"))
    out = per.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("value_count"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("_first", "value"))).alias("example"),
        F.collect_set(value_kind(F.col("value"))).alias("_kinds"),
    )
    out = out.join(first_of_each(per, "field", examples).withColumnRenamed("field", "_field"), F.col("field") == F.col("_field"), "left").drop("_field")
    kind = F.when(F.size("_kinds") == 0, "inconnu").when(F.size("_kinds") == 1, F.col("_kinds")[0]).when(F.size(F.array_except("_kinds", F.array(F.lit("int"), F.lit("float")))) == 0, "float").otherwise("str")
    return out.withColumn("kind", kind).drop("_kinds")
