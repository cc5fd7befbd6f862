"""Audits of referentials: validated filters, anomaly records, states, sorts and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.functions.text import ascii_token, blank_to_null, city_token, group_key, province_key, slug, token
from terralith.operators.quality import Check, anomalies, flags

#: What a code may look like (fixed value).
CODE = r"^[A-Za-z0-9_-]{1,20}$"
#: Stages of a publication in order (fixed values).
STAGES = ("import", "analyze", "validate", "publish")
#: Levels counted ahead of their time, and those of them that need a parent (fixed values).
FUTURE = ("ville", "commune_urbaine", "commune_rurale", "quartier", "secteur", "chefferie", "groupement", "groupement_incorpore", "village")
NEED_PARENT = ("ville", "commune_urbaine", "commune_rurale", "quartier")


def whitelisted(df: DataFrame, column: str, value: str | None, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose column has the value; all rows if it is None; an error if it isn't allowed."""
    if value is None:
        return df
    if value not in allowed:
        raise ValueError(f"{column}: {value!r} is none of {', '.join(allowed)}")
    return df.filter(F.col(column) == value)


def checked_code(code: Column) -> tuple[Column, Column]:
    """The code, trimmed and in capitals, if it is valid, and else what is wrong with it."""
    bare = F.nullif(F.trim(code), F.lit(""))
    valid = bare.rlike(CODE)
    return F.when(valid, F.upper(bare)), F.when(bare.isNull(), "code manquant").when(~valid, "code invalide")


def left_profiles(base: DataFrame, profiles: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """base left-joined to profiles (table, key of base, key of the table).  A profile that repeats its key counts once,
    with its least row, so that no join multiplies rows."""
    for table, own, key in profiles:
        rest = [c for c in table.columns if c != key]
        single = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_least")).select(F.col(key).alias("_key"), "_least.*")
        base = base.join(single, F.col(own) == F.col("_key"), "left").drop("_key")
    return base


def anomaly_records(df: DataFrame, checks: list[Check], key: str, level: str, parents: list[str], duplicates: list[str]) -> DataFrame:
    """One row a failed check and one a member of a duplicate group: entity, level, parents, problem, cause, status."""
    failed = anomalies(df, checks, [key, *parents]).select(key, F.lit(level).alias("level"), *parents, F.col("problem"), F.col("flag").alias("cause"))
    groups = df.groupBy(*duplicates).agg(F.count("*").alias("_n")).filter("_n > 1").select(*(F.col(c).alias(f"_d_{c}") for c in duplicates))
    same = [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in duplicates]
    repeated = df.join(groups, same, "left_semi").select(key, F.lit(level).alias("level"), *parents, F.lit("doublon").alias("problem"), F.lit("duplicate").alias("cause"))
    return failed.unionByName(repeated).withColumn("status", F.lit("a verifier"))


def validated(checks: list[Check]) -> Column:
    """Number of rows without any failed check (aggregate)."""
    return F.count_if(F.size(flags(checks)) == 0)


def conclusion(orphans: Column, unknown_types: Column, reference: Column) -> Column:
    """complet if nothing is orphaned or of unknown type and the reference count is known, else partiel."""
    return F.when((orphans == 0) & (unknown_types == 0) & (reference > 0), "complet").otherwise("partiel")


def future_levels(entities: DataFrame) -> DataFrame:
    """(entity_type, n, orphans): entities (entity_type, parent_source_id) of levels to come, and how many of the types
    that need a parent have none."""
    kind = F.lower(F.trim("entity_type"))
    orphan = kind.isin(*NEED_PARENT) & (F.coalesce(F.trim("parent_source_id"), F.lit("")) == "")
    return entities.filter(kind.isin(*FUTURE)).groupBy(kind.alias("entity_type")).agg(F.count("*").alias("n"), F.count_if(orphan).alias("orphans"))


def moved(sources: DataFrame, moves: DataFrame) -> DataFrame:
    """sources (source, stage) after moves (ord, source, stage): the last move to a known stage holds; `published` says
    whether the source may be used."""
    last = moves.filter(F.col("stage").isin(*STAGES)).groupBy(F.col("source").alias("_s")).agg(F.max_by("stage", "ord").alias("_stage"))
    out = sources.join(last, F.col("source") == F.col("_s"), "left").withColumn("stage", F.coalesce("_stage", "stage"))
    return out.withColumn("published", F.col("stage") == STAGES[-1]).drop("_s", "_stage")


def toggled(column: str, descending: bool) -> Column:
    """Order by the lower-cased value, null as empty."""
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return key.desc() if descending else key.asc()


def priority_order(mode: str, name: str = "id") -> list[Column]:
    """Sort keys of the four modes: completeness (least first), missing (most first), updated (latest first), priority."""
    rank = F.when(F.col("priority") == "critique", 0).when(F.col("priority") == "haute", 1).when(F.col("priority") == "normale", 2).otherwise(9)
    modes = {"completeness": F.col("completeness").asc(), "missing": F.col("missing_fields_count").desc(), "updated": F.col("last_updated_at").desc(), "priority": rank.asc()}
    return [modes.get(mode, modes["priority"]), F.col(name)]


def hinted_values(attributes: Column, hints: list[str]) -> Column:
    """Values of a map whose key contains any hint, by key."""
    wanted = F.map_filter(attributes, lambda k, v: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(k), h)))
    return F.transform(F.array_sort(F.map_entries(wanted)), lambda e: e["value"])


def unreserved(attributes: Column, reserved: list[str]) -> Column:
    """The map without reserved keys."""
    return F.map_filter(attributes, lambda k, v: ~k.isin(*reserved))


def merged(*maps: Column) -> Column:
    """One map of several of text to text; of equal keys the value of the later map counts, null maps are empty."""
    held = [F.coalesce(m, F.create_map().cast("map<string,string>")) for m in maps]
    return reduce(_later_wins, held)


def _later_wins(before: Column, later: Column) -> Column:
    return F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(later, k)), later)


def placemark_attributes(name: Column, extended: Column, description: Column) -> Column:
    """Attributes of a placemark: its name, then its extended data, then what its description says, the later winning."""
    return merged(F.create_map(F.lit("name"), F.coalesce(F.trim(name), F.lit(""))), extended, description)


#: What stands for a missing role of an activity, a missing level of a challenge, and missing names (fixed values).
UNQUALIFIED, ACTIVITY, CHALLENGE = "À qualifier", "Activité", "Défi"


def activities(main: Column, second: Column, others: Column) -> Column:
    """All activities of a profile as an array of nom and role: the main one, the second one, then the others, an array of
    structs of nom, label, role and priorite.  Blank main and second ones are left out; the others keep their order."""
    of = lambda name, role: F.when(blank_to_null(name).isNotNull(), F.struct(name.alias("nom"), F.lit(role).alias("role")))
    first = F.array_compact(F.array(of(main, "Principale"), of(second, "Secondaire")))
    either = lambda x, a, b, none: F.coalesce(blank_to_null(x[a]), blank_to_null(x[b]), F.lit(none))
    rest = F.transform(F.array_compact(others), lambda x: F.struct(either(x, "nom", "label", ACTIVITY).alias("nom"), either(x, "role", "priorite", UNQUALIFIED).alias("role")))
    return F.concat(first, F.coalesce(rest, F.array().cast("array<struct<nom:string,role:string>>")))


def challenges(listed: Column) -> Column:
    """Challenges of a profile as an array of nom and niveau, from structs of nom, label and niveau."""
    named = lambda x: F.coalesce(blank_to_null(x["nom"]), blank_to_null(x["label"]), F.lit(CHALLENGE))
    found = F.transform(F.array_compact(listed), lambda x: F.struct(named(x).alias("nom"), F.coalesce(blank_to_null(x["niveau"]), F.lit(UNQUALIFIED)).alias("niveau")))
    return F.coalesce(found, F.array().cast("array<struct<nom:string,niveau:string>>"))


def attribute_fallback(profile: Column, metadata: Column, *path: str) -> Column:
    """The first non-empty of profile[name], metadata[name] and, if a second name is given, profile[second]."""
    tries = [profile[path[0]], metadata[path[0]], *(profile[p] for p in path[1:])]
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in tries), F.lit(""))


def neighbour_levels(levels: DataFrame) -> DataFrame:
    """levels (rank, level), as many as a hierarchy has, with the one before and the one after."""
    over = Window.orderBy("rank")
    return levels.withColumn("previous", F.lag("level").over(over)).withColumn("next", F.lead("level").over(over))


def tree_anomalies(nodes: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """nodes (id, kind, zone) that are of an unexpected kind or have no zone, one row each fault."""
    kind, zone = ~F.coalesce(F.col("kind").isin(*expected), F.lit(False)), F.coalesce(F.trim("zone"), F.lit("")) == ""
    faults = F.array_compact(F.array(F.when(kind, "type inattendu"), F.when(zone, "zone absente")))
    return nodes.select("id", F.explode(faults).alias("anomaly"))


def less_errors(scores: DataFrame, errors: DataFrame, level: str, weight: int = 2) -> DataFrame:
    """scores (level, score) less `weight` for each error row of the level, 0 at least."""
    counts = errors.groupBy(F.col(level).alias("_level")).agg(F.count("*").alias("errors"))
    joined = scores.join(counts, F.col(level) == F.col("_level"), "left").drop("_level").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return joined.withColumn("score", F.greatest(F.lit(0).cast("long"), F.col("score") - weight * F.col("errors")))


def canonical_ids(kind: str, zone: Column, name: Column, code: Column, territory: Column, parent: Column) -> Column:
    """Identifier of an entity of one of five kinds; what is missing is named.  Every kind has its own way to write
    names."""
    place = lambda c: F.coalesce(F.nullif(ascii_token(c), F.lit("")), F.lit("INCONNU"))
    write = {"groupement": lambda c: token(group_key(c)), "localite": place}.get(kind, token)
    said = lambda c, other: write(F.coalesce(blank_to_null(c), F.lit(other)))
    zone = F.coalesce(blank_to_null(zone), F.lit("INCONNU"))
    code = F.coalesce(blank_to_null(code), F.lit("SANS_CODE"))
    parts = {
        "province": (F.lit("PROV"), F.upper(F.replace(province_key(name), F.lit(" "), F.lit("_")))),
        "ville": (F.lit("VILLE"), city_token(name)),
        "collectivite": (F.lit("COLL"), said(territory, "TERRITOIRE_INCONNU"), said(parent, "INCONNU"), write(name)),
        "groupement": (F.lit("GRPT"), said(parent, "COLLECTIVITE_INCONNUE"), write(name), code),
        "localite": (F.lit("LOC"), said(territory, "TERRITOIRE_INCONNU"), said(parent, "PARENT_INCONNU"), write(name), code),
    }[kind]
    return F.concat_ws("-", F.lit("RDC"), zone, *parts)


def orphan_audit(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """rows without a parent of their key, each with the likely cause."""
    cause = F.when(blank_to_null(F.col(key).cast("string")).isNull(), "code absent").otherwise("code sans parent connu")
    return rows.join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti").withColumn("cause", cause)


def mismatch_fields(messages: DataFrame, message: str) -> DataFrame:
    """(field, n): how often each field is named by messages "FIELD source='..' parent='..'"; others count as AUTRE."""
    field = F.regexp_extract(message, r"^([A-Z]+) source='[^']*' parent='[^']*'$", 1)
    return messages.groupBy(F.when(field == "", "AUTRE").otherwise(field).alias("field")).agg(F.count("*").alias("n"))


def feature_report(features: DataFrame, kind: Column, geometry: Column, description: Column) -> DataFrame:
    """(class, features, without_geometry, described) of every class of features."""
    return features.groupBy(kind.alias("class")).agg(F.count("*").alias("features"), F.count_if(geometry.isNull()).alias("without_geometry"), F.count(description).alias("described"))


def mismatch_examples(messages: DataFrame, message: str, order: str, most: int = 20) -> DataFrame:
    """The first messages in order, and the field that each names: examples beside the counts of mismatch_fields."""
    field = F.regexp_extract(message, r"^([A-Z]+) source='[^']*' parent='[^']*'$", 1)
    return messages.select(order, F.when(field == "", "AUTRE").otherwise(field).alias("field"), message).orderBy(order, message).limit(most)


def reconciled(expected: DataFrame, found: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, n, etat) of every expected key and every found one: trouvée; manquante; inattendue; doublon, if it is found
    more than once; non rattachée, if it is expected and found only without a parent.  Null keys are left out.  Counts
    meet, not rows, so a key that a third of the rows have is one row."""
    want = expected.filter(F.col(key).isNotNull()).select(F.col(key).alias("_e")).distinct()
    have = found.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_f")).agg(F.count("*").alias("n"), F.count(parent).alias("_placed"))
    both = want.join(have, F.col("_e") == F.col("_f"), "full_outer")
    state = F.when(F.col("_f").isNull(), "manquante").when(F.col("_e").isNull(), "inattendue").when(F.col("_placed") == 0, "non rattachée").when(F.col("n") > 1, "doublon").otherwise("trouvée")
    return both.select(F.coalesce("_e", "_f").alias(key), F.coalesce("n", F.lit(0)).alias("n"), state.alias("etat"))


def extraction_gap(found: DataFrame, kind: str, recognised: Column, expected: dict[str, int]) -> DataFrame:
    """(kind, extracted, recognised, additional, expected, gap) of every type that is found or expected: what an
    extraction took, how much of it is the type's own, and how far the extraction lies from the expected number."""
    counts = found.groupBy(F.col(kind).alias("_k")).agg(F.count("*").alias("_n"), F.count_if(recognised).alias("_r"))
    wanted = found.sparkSession.createDataFrame(list(expected.items()), f"{kind} string, expected long")
    both = wanted.join(counts, F.col(kind) == F.col("_k"), "full_outer")
    n, r = F.coalesce("_n", F.lit(0)), F.coalesce("_r", F.lit(0))
    return both.select(F.coalesce(kind, "_k").alias(kind), n.alias("extracted"), r.alias("recognised"), (n - r).alias("additional"), "expected", (n - F.col("expected")).alias("gap"))


def zone_layer(provinces: DataFrame, zones: DataFrame, unnamed: str = "Zone") -> DataFrame:
    """A layer of zones made from provinces (nom, zone, geometry) that have a geometry: layer, code, nom (the zone's, of
    zones: code, nom), province, geometry."""
    names = zones.groupBy(F.col("code").alias("_code")).agg(F.min("nom").alias("_nom"))
    rows = provinces.filter(blank_to_null("geometry").isNotNull()).join(names, F.col("zone") == F.col("_code"), "left")
    return rows.select(F.lit("zones").alias("layer"), F.col("zone").alias("code"), F.coalesce("_nom", F.lit(unnamed)).alias("nom"), F.col("nom").alias("province"), "geometry")


def tree_ids(path: Column) -> Column:
    """Identifier of a tree node: the slugs of its ancestors and itself."""
    return F.array_join(F.transform(path, slug), "--")
