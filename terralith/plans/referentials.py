"""Official referentials, level by level, from placemarks (see sources.kml) to entities, quality and indexes.

Each level is a query over placemarks and the level above.  Placemarks carry ord, path, name, ext (key/value pairs in
order), description, geometry_type and coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions import text as t
from terralith.operators import classify
from terralith.operators import quality as q
from terralith.operators.hierarchy import member_rows, prefix_counts
from terralith.operators.quality import Check
from terralith.operators.resolve import Rule, ordered_fallback_join
from terralith.operators.windows import keep_first
from terralith.sources import kml


def attribute(*keys: str) -> Column:
    """The first non-blank of the extended data under the given keys, in any case."""

    def value(key: str) -> Column:
        return F.try_element_at(F.filter("ext", lambda e: (F.lower(e["k"]) == key.lower()) & (F.trim(e["v"]) != "")), F.lit(1))["v"]

    return F.coalesce(*(F.trim(value(k)) for k in keys))


def _geometry_valid(kind: Column, coordinates: Column) -> Column:
    """Points have coordinates in range; the outer ring of a polygon has four points at least and is closed."""
    ring = F.from_json(F.when(kind == "Polygon", coordinates), "array<array<array<double>>>")[0]
    point = F.from_json(F.when(kind == "Point", coordinates), "array<double>")
    closed = (F.size(ring) >= 4) & (F.slice(F.element_at(ring, 1), 1, 2) == F.slice(F.element_at(ring, -1), 1, 2))
    in_range = F.get(point, 1).between(-90, 90) & F.get(point, 0).between(-180, 180)
    return F.coalesce(F.when(kind == "Polygon", closed).when(kind == "Point", in_range).when(kind == "MultiPolygon", True), F.lit(False))


def provinces(placemarks: DataFrame, zones: DataFrame) -> DataFrame:
    """Placemarks whose name is a province of the zone table (code, province): of equal names the first
    counts, by file and place in it; of several zones of a name the least."""
    known = zones.groupBy(t.province_key("province").alias("_key")).agg(F.min("code").alias("zone"))
    rows = placemarks.withColumn("_key", t.province_key("name")).filter("_key <> ''")
    first = keep_first(rows.withColumn("_place", F.struct("file", "ord") if "file" in rows.columns else F.struct("ord")), ["_key"], "_place").drop("_place")
    joined = first.join(known, "_key")
    capital = F.coalesce(attribute("CHEF_LIEU", "CAPITALE"), F.try_element_at(t.description_pairs("description"), F.lit("chef lieu")))
    out = joined.select("ord", F.col("name").alias("nom"), "zone", F.lit("Province").alias("niveau"), t.clean_code(attribute("CODE_OFFICIEL", "CODE", "CODE_INS")).alias("code"), capital.alias("chef_lieu"), _geometry_valid(F.col("geometry_type"), F.col("coordinates")).alias("geometrie_valide"))
    return scored(out, level_checks("province"))


def level_checks(level: str) -> list[Check]:
    """Checks of a level with the weights of ROW_WEIGHTS, on the columns that the referential of the level has."""
    weights = q.ROW_WEIGHTS[level]
    blank = lambda c: t.blank_to_null(c).isNull()
    failed = {
        "province": {"geometry": ~F.col("geometrie_valide"), "code": F.col("code").isNull(), "capital": blank("chef_lieu")} if level == "province" else {},
        "ville": {"province": blank("province"), "zone": blank("zone"), "geometry": ~F.col("geometrie_valide")},
        "collectivite": {"territory": blank("territoire"), "province": blank("province"), "zone": blank("zone"), "geometry": ~F.col("geometrie_valide"), "type": F.col("type") == classify.UNKNOWN_TYPE},
        "groupement": {"parent": blank("collectivite"), "territory": blank("territoire"), "province": blank("province"), "zone": blank("zone"), "geometry": ~F.col("geometrie_valide"), "code": F.col("code").isNull()},
        "localite": {"orphan": F.col("parent_level").isNull(), "zone": blank("province") | blank("zone"), "geometry": ~F.col("geometrie_valide"), "type": F.col("type") == "Autre"},
    }[level]
    return [Check(name, test, weights[name]) for name, test in failed.items()]


def scored(df: DataFrame, checks: list[Check]) -> DataFrame:
    return df.withColumn("flags", q.flags(checks)).withColumn("score", q.row_score(checks))


def _in_territories() -> Column:
    """Whether the last folder is Territoire(s)."""
    return F.lower(F.trim(F.try_element_at("path", F.lit(-1)))).isin("territoire", "territoires")


def territories(placemarks: DataFrame) -> DataFrame:
    """Placemarks under a folder Territoire(s), at least six deep (the document's name counts): zone and province from
    the path, inconsistencies with the attributes.  Zones are compared as codes, names without accents and in one case;
    an attribute that is missing isn't one."""
    rows = placemarks.filter(_in_territories() & (F.size("path") >= 6))
    province = kml.province_after_marker(F.col("path"))
    rows = rows.withColumn("zone", t.zone_code(kml.zone_of_path(F.col("path")))).withColumn("province", province)
    rows = rows.withColumn("nom", F.coalesce(t.blank_to_null("name"), attribute("NOM", "TERRITOIRE")))
    said_zone, said_province, said_name = t.zone_code(attribute("ZONE")), attribute("PROVINCE"), attribute("NOM")
    differs = lambda a, b: (t.type_key(F.translate(a, "-_", "  ")) != t.type_key(F.translate(b, "-_", "  ")))
    problems = F.array_compact(F.array(F.when(said_zone != F.col("zone"), "zone"), F.when(differs(said_province, F.col("province")), "province"), F.when(differs(said_name, F.col("nom")), "nom")))
    chain = F.array(F.lit("RDC"), F.concat(F.lit("Zone "), t.zone_label("zone")), F.col("province"), F.col("nom"))
    rows = rows.withColumn("incoherences", problems)
    points = 100.0 - F.when(F.col("geometry_type").isNull(), 40).otherwise(0) - F.when(F.size("ext") == 0, 10).otherwise(0) - F.least(F.lit(40), 15 * F.size("incoherences"))
    return rows.select("ord", "nom", "zone", "province", attribute("TYPE").alias("type"), t.clean_code(attribute("CODE_INS", "CODE")).alias("code"), chain.alias("chaine"), "incoherences", F.greatest(F.lit(0.0), points).alias("score"))


def cities(placemarks: DataFrame) -> DataFrame:
    """Named placemarks whose TYPE is Commune(s) in a folder Territoire(s) exactly six deep (the document's name counts)."""
    named = t.blank_to_null("name").isNotNull()
    rows = placemarks.filter(named & _in_territories() & (F.size("path") == 6) & F.lower(attribute("TYPE")).isin("commune", "communes"))
    out = rows.select("ord", F.coalesce(t.blank_to_null("name"), attribute("NOM")).alias("nom"), t.zone_code(kml.zone_of_path(F.col("path"))).alias("zone"), kml.province_after_marker(F.col("path")).alias("province"), _geometry_valid(F.col("geometry_type"), F.col("coordinates")).alias("geometrie_valide"))
    return scored(out.withColumn("canonical_id", F.concat_ws("-", F.lit("VILLE"), t.city_token("province"), t.city_token("nom"))), level_checks("ville"))


def city_quality(cities_: DataFrame) -> DataFrame:
    """Global score: orphans, geometry, names in several provinces or zones, duplicates."""
    names = cities_.groupBy(t.city_token("nom").alias("_k")).agg(F.count("*").alias("n"), F.countDistinct("province").alias("p"), F.countDistinct("zone").alias("z"))
    several = names.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)).alias("duplicates"), F.count_if(F.col("p") > 1).alias("multi_province"), F.count_if(F.col("z") > 1).alias("multi_zone")).withColumn("_j", F.lit(1))
    counts = cities_.agg(F.count("*").alias("entities"), F.count_if(F.col("province").isNull()).alias("orphan"), F.count_if(~F.col("geometrie_valide")).alias("geometry")).withColumn("_j", F.lit(1))
    one = counts.join(several, "_j").drop("_j")
    return one.withColumn("score", q.penalty_score(F.col("entities"), list(q.GLOBAL_WEIGHTS["ville"].items())))


def collectivities(placemarks: DataFrame, territories_: DataFrame) -> DataFrame:
    """Sectors and chiefdoms (other explicit types are left out), with the place that told the type; the territory is
    found by the first four digits of the code.  territories_ (ord, nom, province, zone, code)."""
    kind, source = classify.collectivity_type(F.col("ext"), F.col("description"), F.col("path"))
    rows = placemarks.withColumn("type", kind).withColumn("type_source", source).filter("type <> 'Autre'")
    rows = rows.withColumn("code", t.clean_code(attribute("CODE_INS", "CODE"))).withColumn("nom", F.coalesce(t.blank_to_null("name"), attribute("NOM")))
    parents = territories_.select("ord", F.substring("code", 1, 4).alias("_code"), F.col("nom").alias("territoire"), F.col("province").alias("_p"), F.col("zone").alias("_z"))
    found = ordered_fallback_join(rows, [Rule("code", (F.substring("code", 1, 4),), parents, ("_code",), "territoire")], ["territoire", "_p", "_z"])
    out = found.select("ord", "nom", "type", "type_source", "code", "territoire", F.coalesce("_p", kml.province_of_collectivities(F.col("path"))).alias("province"), F.coalesce("_z", t.zone_code(kml.zone_of_path(F.col("path")))).alias("zone"), "resolution", _geometry_valid(F.col("geometry_type"), F.col("coordinates")).alias("geometrie_valide"))
    return scored(out, level_checks("collectivite"))


def groupings(placemarks: DataFrame, collectivities_: DataFrame) -> DataFrame:
    """Groupings find their collectivity by the first six digits of their code, else by name and territory; attributes
    that name another parent are inconsistencies.  collectivities_ (ord, nom, territoire, province, zone, code)."""
    rows = placemarks.withColumn("code", t.clean_code(attribute("CODE_GRPT", "PCODE"))).withColumn("nom", F.coalesce(t.blank_to_null("name"), attribute("GROUPEMENT", "NOM_RGC", "NOM")))
    rows = rows.withColumn("_said", attribute("COLLECTIV")).withColumn("_said_t", attribute("TERRITOIRE"))
    parents = collectivities_.select("ord", F.col("nom").alias("collectivite"), "territoire", "province", "zone", F.substring("code", 1, 6).alias("_c6"), t.group_key("nom").alias("_n"), t.group_key("territoire").alias("_t"))
    rules = [
        Rule("code", (F.substring("code", 1, 6),), parents, ("_c6",), "collectivite"),
        Rule("nom", (t.group_key("_said"), t.group_key("_said_t")), parents, ("_n", "_t"), "collectivite"),
    ]
    found = ordered_fallback_join(rows, rules, ["collectivite", "territoire", "province", "zone"])
    differs = lambda a, b: t.group_key(a) != t.group_key(b)
    problems = F.array_compact(F.array(F.when(differs("_said", "collectivite"), F.format_string("COLLECTIV source='%s' parent='%s'", "_said", "collectivite")), F.when(differs("_said_t", "territoire"), F.format_string("TERRITOIRE source='%s' parent='%s'", "_said_t", "territoire"))))
    out = found.select("ord", "nom", "code", "collectivite", "territoire", "province", "zone", "resolution", problems.alias("incoherences"), _geometry_valid(F.col("geometry_type"), F.col("coordinates")).alias("geometrie_valide"))
    out = scored(out, level_checks("groupement"))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.col("score") - F.least(F.lit(20), 5 * F.size("incoherences"))))


def grouping_quality(groupings_: DataFrame) -> DataFrame:
    """Global score of the level, inconsistencies and duplicates counted in."""
    twice = q.duplicate_groups(groupings_.withColumn("_k", t.group_key("nom")), ["_k", "collectivite"]).agg(F.count("*").alias("duplicates")).withColumn("_j", F.lit(1))
    counts = groupings_.agg(F.count("*").alias("entities"), *q.failed_counts(level_checks("groupement")), F.count_if(F.size("incoherences") > 0).alias("inconsistency")).withColumn("_j", F.lit(1))
    return counts.join(twice, "_j").drop("_j").withColumn("score", q.penalty_score(F.col("entities"), list(q.GLOBAL_WEIGHTS["groupement"].items())))


def localities(placemarks: DataFrame, groupings_: DataFrame, collectivities_: DataFrame, territories_: DataFrame) -> DataFrame:
    """Localities find their parent by five rules in turn: grouping code; grouping, collectivity and territory names;
    collectivity by six digits of the place code; collectivity and territory names; territory name."""
    rows = placemarks.withColumn("nom", F.coalesce(t.blank_to_null("name"), attribute("NOM")))
    rows = rows.withColumn("code", t.clean_code(attribute("PCODE", "CODE")))
    for out, key in (("_g", "GROUPEMENT"), ("_c", "COLLECTIV"), ("_t", "TERRITOIRE")):
        rows = rows.withColumn(out, t.ascii_key(attribute(key)))
    rows = rows.withColumn("_grpt", t.clean_code(attribute("CODE_GRPT")))
    haystack = t.ascii_key(F.concat_ws(" ", "nom", F.coalesce("description", F.lit("")), F.array_join("path", " ")))
    kind, reason = classify.locality_type(haystack, t.clean_code(attribute("TYPE")))
    rows = rows.withColumn("type", kind).withColumn("type_reason", reason)
    none = F.lit(None).cast("string")
    g = groupings_.select("ord", F.col("nom").alias("groupement"), "collectivite", "territoire", "province", "zone", F.col("code").alias("_code"), t.ascii_key("nom").alias("_n"), t.ascii_key("collectivite").alias("_pc"), t.ascii_key("territoire").alias("_pt"))
    c = collectivities_.select("ord", none.alias("groupement"), F.col("nom").alias("collectivite"), "territoire", "province", "zone", F.substring("code", 1, 6).alias("_code"), t.ascii_key("nom").alias("_n"), t.ascii_key("territoire").alias("_pt"))
    p = territories_.select("ord", none.alias("groupement"), none.alias("collectivite"), F.col("nom").alias("territoire"), "province", "zone", t.ascii_key("nom").alias("_n"))
    rules = [
        Rule("CODE_GRPT", (F.col("_grpt"),), g, ("_code",), "groupement"),
        Rule("noms groupement", (F.col("_g"), F.col("_c"), F.col("_t")), g, ("_n", "_pc", "_pt"), "groupement"),
        Rule("PCODE", (F.substring("code", 1, 6),), c, ("_code",), "collectivite"),
        Rule("noms collectivite", (F.col("_c"), F.col("_t")), c, ("_n", "_pt"), "collectivite"),
        Rule("nom territoire", (F.col("_t"),), p, ("_n",), "territoire", "first"),
    ]
    found = ordered_fallback_join(rows, rules, ["groupement", "collectivite", "territoire", "province", "zone"])
    out = found.withColumn("geometrie_valide", _geometry_valid(F.col("geometry_type"), F.col("coordinates"))).withColumn("sans_coordonnees", F.col("coordinates").isNull())
    parent = F.coalesce("groupement", "collectivite", "territoire")
    out = out.withColumn("canonical_id", F.concat_ws("-", F.lit("LOC"), F.coalesce(t.ascii_token(parent), F.lit("PARENT_INCONNU")), F.coalesce("code", F.lit("SANS_CODE")), t.ascii_token("nom")))
    return scored(out, level_checks("localite")).select("ord", "nom", "code", "type", "type_reason", "groupement", "collectivite", "territoire", "province", "zone", "resolution", "parent_level", "canonical_id", "geometrie_valide", "sans_coordonnees", "flags", "score")


def locality_quality(localities_: DataFrame) -> DataFrame:
    """Global score of the level: localities without parent, those that can't be attached (no province, or no zone),
    without valid geometry, without coordinates, of unknown type, and keys that several share."""
    several = q.duplicate_groups(localities_.filter("canonical_id IS NOT NULL"), ["canonical_id"]).agg(F.count("*").alias("duplicates")).withColumn("_j", F.lit(1))
    blank = lambda c: t.blank_to_null(c).isNull()
    counts = localities_.agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("parent_level").isNull()).alias("orphan"),
        F.count_if(blank("province") | blank("zone")).alias("unattachable"),
        F.count_if(~F.col("geometrie_valide")).alias("geometry"),
        F.count_if(F.col("sans_coordonnees")).alias("coordinates"),
        F.count_if(F.col("type") == "Autre").alias("type"),
    ).withColumn("_j", F.lit(1))
    return counts.join(several, "_j").drop("_j").withColumn("score", q.penalty_score(F.col("entities"), list(q.GLOBAL_WEIGHTS["localite"].items())))


def locality_indexes(localities_: DataFrame) -> DataFrame:
    """Counts by province, territory, collectivity and grouping prefixes, in one pass (see locality_members)."""
    return prefix_counts(_index_rows(localities_), INDEX_LEVELS).filter("depth > 0")


def locality_members(localities_: DataFrame) -> DataFrame:
    """Members of all prefixes, in order: one row a locality under its full path, so that a prefix is a run of rows."""
    return member_rows(_index_rows(localities_), INDEX_LEVELS, F.col("nom"))


INDEX_LEVELS = ["province", "territoire", "collectivite", "groupement"]


def _index_rows(localities_: DataFrame) -> DataFrame:
    return localities_.select(*(F.coalesce(c, F.lit("")).alias(c) for c in INDEX_LEVELS), "nom")


def coverage_audit(territories_: DataFrame, collectivities_: DataFrame, groupings_: DataFrame) -> DataFrame:
    """One row a province: territories and collectivities, how many of them have a grouping, percent and band."""
    with_t = groupings_.select(F.col("territoire").alias("_t"), F.col("province").alias("_tp")).dropna().distinct()
    with_c = groupings_.select(F.col("collectivite").alias("_c"), F.col("territoire").alias("_ct")).dropna().distinct()
    t_rows = territories_.join(with_t, (F.col("nom") == F.col("_t")) & (F.col("province") == F.col("_tp")), "left").groupBy("province").agg(F.count("*").alias("territoires"), F.count("_t").alias("territoires_couverts"))
    c_rows = collectivities_.join(with_c, (F.col("nom") == F.col("_c")) & (F.col("territoire") == F.col("_ct")), "left").groupBy(F.col("province").alias("_p")).agg(F.count("*").alias("collectivites"), F.count("_c").alias("couvertes"))
    joined = t_rows.join(c_rows, F.col("province") == F.col("_p"), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = joined.select(F.coalesce("province", "_p").alias("province"), *(zero(F.col(c)).alias(c) for c in ("territoires", "territoires_couverts", "collectivites", "couvertes")))
    return out.withColumn("pourcentage", q.percent(F.col("couvertes"), F.col("collectivites"))).withColumn("bande", q.coverage_band(F.col("couvertes"), F.col("collectivites")))
