"""Knowledge profiles: sections with defaults, search, completeness.

values: entity, entity_type, section, value (long format)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections of a profile, in order (fixed values).
SECTIONS = (
    ("presentation", "Présentation"),
    ("administration", "Administration"),
    ("geographie", "Géographie"),
    ("subdivision", "Subdivision"),
    ("population", "Population"),
    ("activites_economiques_principales", "Activités économiques principales"),
    ("activites_economiques_secondaires", "Activités économiques secondaires"),
    ("particularites", "Particularités"),
    ("defis", "Défis"),
    ("potentiel_agricole", "Potentiel agricole"),
    ("potentiel_minier", "Potentiel minier"),
    ("potentiel_forestier", "Potentiel forestier"),
    ("potentiel_touristique", "Potentiel touristique"),
    ("potentiel_numerique", "Potentiel numérique"),
    ("services_publics", "Services publics"),
    ("connectivite", "Connectivité"),
    ("infrastructures", "Infrastructures"),
    ("documents", "Documents"),
    ("photos", "Photos"),
    ("rapports", "Rapports"),
    ("historique", "Historique"),
    ("sources", "Sources"),
    ("analyse", "Analyse"),
)
MISSING = "Donnée non encore renseignée"


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(SECTIONS)], "rank int, section string, label string")


def profiles(values: DataFrame) -> DataFrame:
    """Every section of every entity, in order; missing ones have a default value and completeness 0."""
    known = values.filter(F.trim("value") != "").groupBy("entity", "section").agg(F.min("value").alias("value"))
    grid = values.select("entity", "entity_type").distinct().withColumn("_s", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("section"), F.lit(v).alias("label")) for i, (k, v) in enumerate(SECTIONS)))))
    grid = grid.select("entity", "entity_type", "_s.*")
    joined = grid.join(known, ["entity", "section"], "left")
    filled = F.col("value").isNotNull()
    return joined.select("entity", "entity_type", "rank", "section", "label", F.coalesce("value", F.lit(MISSING)).alias("value"), F.when(filled, 100).otherwise(0).alias("completeness"))


def search(values: DataFrame, text: str) -> DataFrame:
    """Entities whose title, type or any value contains the text: labels of the sections that do, the first value as
    an excerpt, and the whole mean of completeness."""
    sought = text.strip().lower()
    full = profiles(values)
    hit = (F.col("completeness") == 100) & (F.lower("value").contains(sought) | F.lower("label").contains(sought))
    known = F.when(F.col("completeness") == 100, F.struct("rank", "value"))
    out = full.groupBy("entity", "entity_type").agg(
        F.array_sort(F.collect_list(F.when(hit, F.struct("rank", "label")))).alias("_labels"),
        F.min(known).alias("_first"),
        F.floor(F.avg("completeness")).cast("int").alias("completeness"),
        F.bool_or((F.col("completeness") == 100) & F.lower("value").contains(sought)).alias("_in_values"),
    )
    titled = F.lower(F.concat_ws(" ", "entity", "entity_type")).contains(sought)
    labels = F.transform("_labels", lambda x: x["label"])
    fields = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("Présentation")))
    return out.filter(F.lit(sought != "") & (F.col("_in_values") | titled)).select("entity", "entity_type", fields.alias("matched_fields"), F.coalesce("_first.value", F.lit(MISSING)).alias("excerpt"), "completeness")
