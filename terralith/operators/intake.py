"""What an import shows and reports before it is taken: first values, anomalies, structure sheets, children by layer, and
the report of a normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.text import blank_to_null
from terralith.operators import staging
from terralith.operators.geometry import valid_lon_lat
from terralith.operators.quality import first_of_each
from terralith.operators.windows import carry_forward

#: Layers below a layer, and the column of a child that names its ancestor there (fixed values).
CHILD_LAYERS = {
    "zones": (("provinces",), "zone_fdsu"),
    "provinces": (("territoires",), "province"),
    "territoires": (("collectivites", "groupements", "villages"), "territoire"),
    "collectivites": (("groupements", "villages"), "collectivite"),
    "groupements": (("villages",), "groupement"),
    "villages": (("sites",), "localite"),
}

#: Fields whose column an import should have, with their labels (fixed values).
EXPECTED_FIELDS = {"nom": "Nom", "province": "Province", "territoire": "Territoire"}


def value_preview(df: DataFrame, order: str, fields: list[str], n: int = 3) -> DataFrame:
    """(field, examples): the first n distinct non-blank values of every field, by `order`, in one pass; a field without
    any has an empty list."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields))
    long = df.select(F.col(order).alias("_ord"), F.explode(pairs).alias("_x")).select("_ord", "_x.field", "_x.value").filter("value <> ''")
    found = first_of_each(long.groupBy("field", "value").agg(F.min("_ord").alias("_first")), "field", n)
    asked = df.sparkSession.createDataFrame([(f,) for f in fields], "_field string")
    joined = asked.join(found, F.col("_field") == F.col("field"), "left")
    return joined.select(F.col("_field").alias("field"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def missing_columns(df: DataFrame, detected: dict[str, str]) -> DataFrame:
    """(type, row, message) of the expected fields that no column was detected for."""
    lost = [f"Colonne manquante probable : {label}." for field, label in EXPECTED_FIELDS.items() if not detected.get(field)]
    if not (detected.get("latitude") and detected.get("longitude")):
        lost.append("Colonnes latitude/longitude non détectées.")
    return df.sparkSession.createDataFrame([("colonnes_manquantes", None, m) for m in lost], "type string, row long, message string")


def import_anomalies(df: DataFrame, detected: dict[str, str], row: str) -> DataFrame:
    """(type, row, message): missing columns, rows that repeat an earlier row's name, province and territory, impossible
    coordinates, rows without any parent.

    detected: column of each field; row: column of the rows' numbers in their file.  Rows without name, province and
    territory are passed over.  The first row of each key comes from an aggregate and a join, so that a hot key is
    combined before the shuffle.
    """

    def cell(field: str) -> Column:
        return blank_to_null(F.col(detected[field]).cast("string")) if detected.get(field) else F.lit(None).cast("string")

    fields = ("nom", "province", "territoire", "collectivite", "groupement", "latitude", "longitude")
    rows = df.select(F.col(row).cast("long").alias("row"), *(cell(f).alias(f) for f in fields))
    key = F.struct(*(F.lower(F.trim(F.coalesce(f, F.lit("")))).alias(f) for f in ("nom", "province", "territoire")))
    rows = rows.filter(F.coalesce("nom", "province", "territoire").isNotNull()).withColumn("_key", key)
    first = rows.groupBy(F.col("_key").alias("_k")).agg(F.min("row").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(first, F.col("_key") == F.col("_k"), "left")
    lat, lon = (F.regexp_replace(c, ",", ".") for c in ("latitude", "longitude"))
    at = F.col("row").cast("string")
    bad = F.coalesce(lat, lon).isNotNull() & ~valid_lon_lat(lon.try_cast("double"), lat.try_cast("double"))

    def found(condition: Column, kind: str, message: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("type"), F.col("row"), message.alias("message")))

    again = F.concat(F.lit("Doublon probable ligne "), at, F.lit(" avec ligne "), F.col("_first").cast("string"), F.lit(" : "), F.coalesce("nom", F.lit("")), F.lit("."))
    all_found = F.array_compact(
        F.array(
            found(F.col("row") > F.col("_first"), "doublons_probables", again),
            found(bad, "coordonnees_invalides", F.concat(F.lit("Coordonnées invalides ligne "), at, F.lit("."))),
            found(F.coalesce("province", "territoire", "collectivite", "groupement").isNull(), "sans_rattachement", F.concat(F.lit("Entité sans rattachement ligne "), at, F.lit("."))),
        )
    )
    return missing_columns(df, detected).unionByName(rows.select(F.explode(all_found).alias("_a")).select("_a.*"))


def children_by_layer(layer: str, parents: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(parent, layer, child): the rows of every layer below `layer` that name a parent (nom; for zones its zone_fdsu or code).

    tables: the layers (nom and the ancestors' columns); those that are absent are passed over.  A name that several
    parents share gives its children to each.
    """
    below, column = CHILD_LAYERS[layer]
    names = [c for c in ("zone_fdsu", "code") if c in parents.columns] if layer == "zones" else ["nom"]
    known = parents.select("nom", F.explode(F.array_distinct(F.array(*(blank_to_null(c) for c in names)))).alias("_name")).filter("_name IS NOT NULL").distinct()
    out = None
    for child in below:
        if child in tables:
            rows = tables[child].select(F.col("nom").alias("child"), F.col(column).alias("_above"))
            part = rows.join(known, F.col("_above") == F.col("_name")).select(F.col("nom").alias("parent"), F.lit(child).alias("layer"), "child")
            out = part if out is None else out.unionByName(part)
    return parents.sparkSession.createDataFrame([], "parent string, layer string, child string") if out is None else out


def structure_rows(rows: DataFrame) -> DataFrame:
    """Rows of structure sheets (sheet_ord, row, zone, province_code, province_name, territory_code, territory_name,
    sites) with `province`, the code of the province that each belongs to, and `kind`: ignored (nothing in it, or the
    zone's title), error (no province above it), repeated, or taken.

    A province row has code and name and holds for the rows below it in its sheet.  A sheet is one window: a
    workbook's sheet has at most 2^20 rows.
    """
    text = {c: blank_to_null(F.trim(F.col(c).cast("string"))) for c in ("province_code", "province_name", "territory_code", "territory_name")}
    rows = rows.withColumns(text).withColumn("own", F.col("province_code").isNotNull() & F.col("province_name").isNotNull())
    rows = carry_forward(rows, F.when(F.col("own"), F.col("province_code")), "province", ["sheet_ord"], ["row"])
    rest = F.coalesce("province_name", "territory_code", "territory_name")
    ignored = rest.isNull() & (F.col("province_code").isNull() | (F.col("province_code") == F.col("zone")))
    place, key = F.struct("sheet_ord", "row"), [F.coalesce(c, F.lit("")) for c in ("province", "territory_code", "province_name")]
    rows = rows.withColumn("_place", place).withColumn("_key", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))).withColumn("_ignored", ignored)
    first = rows.filter(~F.col("_ignored") & F.col("province").isNotNull()).groupBy(F.col("_key").alias("_k")).agg(F.min("_place").alias("_first"))
    rows = rows.join(first, F.col("_key") == F.col("_k"), "left")
    kind = F.when(F.col("_ignored"), "ignored").when(F.col("province").isNull(), "error").when(F.col("_place") > F.col("_first"), "repeated").otherwise("taken")
    return rows.withColumn("kind", kind).drop("_key", "_k", "_first", "_ignored")


def structure_plan(rows: DataFrame, provinces: DataFrame, territories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provinces (code, nom, zone, action) and territories (province, code, nom, sites, action) that structure sheets
    ask for; of several rows of one the last counts.  Actions are insert, update (something differs) or unchanged.

    provinces (code, nom, zone) and territories (province, code, nom, sites) have one row a key.
    """
    taken = structure_rows(rows).filter("kind = 'taken'")
    asked = taken.groupBy(F.col("province").alias("code")).agg(F.max_by("province_name", F.when(F.col("own"), F.col("_place"))).alias("nom"), F.max_by("zone", "_place").alias("zone"))
    old = provinces.select(F.col("code").alias("_code"), F.col("nom").alias("_nom"), F.col("zone").alias("_zone"), F.lit(True).alias("_there"))
    out = asked.join(old, F.col("code") == F.col("_code"), "left")
    same = F.col("nom").eqNullSafe(F.col("_nom")) & F.col("zone").eqNullSafe(F.col("_zone"))
    below = taken.filter("territory_code IS NOT NULL AND territory_name IS NOT NULL").groupBy("province", F.col("territory_code").alias("code"))
    below = below.agg(F.max_by("territory_name", "_place").alias("nom"), F.max_by(F.coalesce("sites", F.lit(0)), "_place").alias("sites"))
    was = territories.select(F.col("province").alias("_province"), F.col("code").alias("_code"), F.col("nom").alias("_nom"), F.coalesce("sites", F.lit(0)).alias("_sites"), F.lit(True).alias("_there"))
    below = below.join(was, (F.col("province") == F.col("_province")) & (F.col("code") == F.col("_code")), "left")
    alike = F.col("nom").eqNullSafe(F.col("_nom")) & (F.col("sites") == F.col("_sites"))

    def action(equal: Column) -> Column:
        return F.when(F.col("_there").isNull(), "insert").when(equal, "unchanged").otherwise("update").alias("action")

    return out.select("code", "nom", "zone", action(same)), below.select("province", "code", "nom", "sites", action(alike))


def positional_import(rows: DataFrame, order: str, required: list[str], key: list[str], existing: DataFrame, parents: DataFrame | None = None, parent: str | None = None, parent_key: str = "code") -> DataFrame:
    """rows of a workbook read by position, each with action and reason: skip if a required column is blank, error if
    its parent isn't there (parents, column parent_key), skip if its key is among the existing ones or was taken by an
    earlier row, else insert.  A row that is skipped or in error takes no key.

    existing has the columns `key`; keys are compared as text.  First rows are found by an aggregate and a join, so a key
    that a third of the rows have is no single task.
    """
    out = rows
    missing = reduce(lambda a, b: a | b, (blank_to_null(F.col(c).cast("string")).isNull() for c in required))
    if parents is None:
        out = out.withColumn("_there", F.lit(True))
    else:
        known = parents.select(F.col(parent_key).cast("string").alias("_parent")).dropna().distinct()
        out = out.join(known, F.col(parent).cast("string") == F.col("_parent"), "left").withColumn("_there", F.col("_parent").isNotNull()).drop("_parent")
    out = out.withColumn("_ok", ~missing & F.col("_there")).withColumn("_key", F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key))))
    held = existing.select(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key))).alias("_known")).distinct()
    first = out.filter("_ok").groupBy(F.col("_key").alias("_k")).agg(F.min(order).alias("_first"))
    out = out.join(held, F.col("_key") == F.col("_known"), "left").join(first, F.col("_key") == F.col("_k"), "left")
    reason = F.when(missing, "champ manquant").when(~F.col("_there"), "parent introuvable").when(F.col("_known").isNotNull(), "déjà présent").when(F.col(order) > F.col("_first"), "répété")
    out = out.withColumn("reason", reason)
    action = F.when(F.col("reason").isNull(), "insert").when(F.col("reason") == "parent introuvable", "error").otherwise("skip")
    return out.withColumn("action", action).select(*rows.columns, "action", "reason")


def normalisation_report(prepared: DataFrame, source: str) -> DataFrame:
    """(source, section, item, n) of prepared staging rows: their number, the number of each level, of each issue, and of
    merge candidates.  The rows themselves come from staging.issues and staging.matches."""
    total = prepared.agg(F.count("*").alias("n")).select(F.lit("entities").alias("section"), F.lit("all").alias("item"), "n")
    levels = prepared.groupBy(F.col("entity_type").alias("item")).agg(F.count("*").alias("n")).select(F.lit("levels").alias("section"), "item", "n")
    issues = staging.issues(prepared).groupBy(F.col("issue").alias("item")).agg(F.count("*").alias("n")).select(F.lit("issues").alias("section"), "item", "n")
    merges = staging.matches(prepared).agg(F.count("*").alias("n")).select(F.lit("merges").alias("section"), F.lit("candidates").alias("item"), "n")
    out = total.unionByName(levels).unionByName(issues).unionByName(merges)
    return out.select(F.lit(source).alias("source"), "section", "item", "n")
