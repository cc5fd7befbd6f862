"""Rule tables compiled to CASE chains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.functions.text import description_pairs, type_key

#: Classes of geographic features and the words that tell them, in order (fixed values).
FEATURE_RULES = (
    ("Province", ("province",)),
    ("Territoire", ("territoire",)),
    ("Secteur", ("secteur",)),
    ("Chefferie", ("chefferie",)),
    ("Collectivite", ("collectivite",)),
    ("Groupement", ("groupement",)),
    ("Village", ("village",)),
    ("Site", ("site", "station", "antenne")),
    ("Ville", ("ville",)),
    ("Commune", ("commune",)),
)

#: Categories of source folders, in order (fixed values).
CATEGORY_RULES = (
    ("Télécommunications", ("telecom", "antenne", "bts", "site", "fibre", "cell", "tower", "radio")),
    ("Sites", ("site", "emplacement", "station")),
    ("Planification", ("plan", "phase", "deploiement", "priorite")),
    ("Couverture", ("couverture", "coverage", "signal")),
    ("Backbone", ("backbone", "fibre", "trunk", "liaison")),
    ("Population", ("population", "demographie", "menage", "habitants")),
    ("Statistiques", ("kpi", "stat", "indicateur", "score", "ratio")),
    ("Documents", ("document", "rapport", "fiche", "pdf", "reference")),
    ("Photos", ("photo", "image", "media", "capture")),
    ("Référentiel administratif", ("province", "territoire", "commune", "secteur", "chefferie", "groupement", "village", "collectivite", "administratif")),
)

#: Further tags and their words, in order (fixed values).
TAG_RULES = (
    ("Sites", ("site", "bts", "station")),
    ("Backbone", ("backbone", "fibre")),
    ("Province", ("province",)),
    ("Territoire", ("territoire",)),
    ("Village", ("village",)),
    ("Collectivité", ("collectivite", "secteur", "chefferie", "groupement")),
    ("Déploiement", ("deploiement", "phase", "plan")),
    ("KPI", ("kpi", "indicateur", "score", "ratio")),
    ("Télécommunications", ("telecom", "antenne", "fibre", "radio", "couverture")),
)

#: Staging types by hints in names and type attributes; a more particular hint comes before one it contains (fixed
#: values).
STAGING_RULES = (
    ("zone", ("ZONE ", " ND", " SD", " CE", " OT", " ET")),
    ("province", ("PROVINCE",)),
    ("ville", ("VILLE", "CITY")),
    ("territoire", ("TERRITOIRE", "TERRITORY")),
    ("commune_urbaine", ("COMMUNE URBAINE",)),
    ("commune_rurale", ("COMMUNE RURALE",)),
    ("secteur", ("SECTEUR",)),
    ("chefferie", ("CHEFFERIE",)),
    ("groupement_incorpore", ("GROUPEMENT INCORPORE",)),
    ("groupement", ("GROUPEMENT",)),
    ("quartier", ("QUARTIER",)),
    ("village", ("VILLAGE",)),
)

#: Locality types by the digit of the source (fixed values).
LOCALITY_CODES = {"0": "Village", "4": "Cité", "5": "Quartier", "6": "Localité", "7": "Camp", "8": "Village", "9": "Localité"}
#: Which type counts of several digits (fixed values).
LOCALITY_PRIORITY = ("Cité", "Quartier", "Camp", "Localité", "Village")


#: Map colours by thematic mode: words, the colour where one of them occurs, the colour elsewhere (fixed values).
THEMES = {
    "economic": (("commerce",), "#f97316", "#16a34a"),
    "agriculture": (("agriculture",), "#22c55e", "#84cc16"),
    "mining": (("mine", "minier"), "#a855f7", "#64748b"),
    "network": (("faible", "absence"), "#dc2626", "#2563eb"),
    "challenges": (("critique", "insécurité", "insecurite"), "#b91c1c", "#f59e0b"),
    "infrastructure": (("route", "port", "aéroport"), "#0891b2", "#64748b"),
    "priority": (("priorité", "priorite"), "#7c3aed", "#0f766e"),
}
PLAIN_COLOUR = "#0f766e"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_rule(text: Column, rules, default: str) -> Column:
    """Label of the first rule one of whose words the text contains."""
    out = None
    for label, words in rules:
        hit = contains_any(text, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def thematic_colour(text: Column, mode: str | None) -> Column:
    """Colour of a feature in a thematic mode, by its search text (in lower case); unknown modes have one for all."""
    if mode not in THEMES:
        return F.lit(PLAIN_COLOUR)
    words, hit, miss = THEMES[mode]
    return F.when(contains_any(text, words), hit).otherwise(miss)


def matched_terms(text: Column, rules) -> Column:
    """Words of the first matching rule that the text contains."""
    out = None
    for _, words in rules:
        hit = contains_any(text, words)
        found = F.array_compact(F.array(*(F.when(text.contains(w), w) for w in words)))
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out.otherwise(F.array().cast("array<string>"))


def confidence(text: Column, rules) -> Column:
    """0.4 and 0.15 for each word found, 1 at most; 0 if no rule matches."""
    n = F.size(matched_terms(text, rules))
    return F.when(n > 0, F.least(F.lit(1.0), 0.4 + 0.15 * n)).otherwise(0.0)


def tags(text: Column, rules=CATEGORY_RULES, more=TAG_RULES) -> Column:
    """Category first, then every further tag whose words occur; each once, in order."""
    found = F.array(first_rule(text, rules, "Autres"), *(F.when(contains_any(text, words), tag) for tag, words in more))
    return F.array_distinct(F.array_compact(found))


def staging_type(candidates: Column, zone: Column, province: Column, territory: Column, geometry: Column) -> Column:
    """Type from the first rule that any candidate text meets (rules first, then candidates), else from what is filled."""
    out = None
    for label, hints in STAGING_RULES:
        hit = F.exists(candidates, lambda c: contains_any(c, hints))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return (
        out.when(zone.isNotNull(), "zone")
        .when(territory.isNotNull() & province.isNull(), "territoire")
        .when(province.isNotNull() & (geometry == "Polygon") & territory.isNull(), "province")
        .when(geometry == "Point", "village")
        .otherwise("unknown")
    )


#: Types that are no collectivity's, keys and hints that name a type, and what is said if nothing does (fixed values).
OTHER_TYPES = ("commune", "communes", "cite", "cites", "ville", "villes", "territoire", "territoires")
TYPE_KEYS = ("type", "type_collectivite", "nature", "categorie")
TYPE_HINTS = ("type", "nature", "categorie")
UNKNOWN_TYPE, UNKNOWN_SOURCE = "Type inconnu", "Non determine"


#: Cities that the audit tells by name (fixed values).
AUDIT_CITIES = ("kananga", "mbuji-mayi", "mwene ditu", "likasi", "lubumbashi", "kolwezi", "butembo", "beni", "goma", "bukavu", "kindu")


def audit_type(kind: Column, name: Column) -> Column:
    """Territoire or Commune by the attribute TYPE, else Ville by name, else Autre."""
    said = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(said == "territoire", "Territoire").when(said.isin("commune", "communes"), "Commune").when(F.lower(F.trim(name)).isin(*AUDIT_CITIES), "Ville").otherwise("Autre")


def _collectivity(text: Column) -> Column:
    key = type_key(text)
    return F.when(key.contains("secteur"), "Secteur").when(key.contains("chefferie"), "Chefferie")


def collectivity_type(ext: Column, description: Column, path: Column) -> tuple[Column, Column]:
    """Secteur, Chefferie, Autre (another type is named) or Type inconnu, and which place told it: the attribute TYPE, another
    attribute, a pair of the description, the description's text, the folders; the first that says anything counts.
    ext: array of (k, v) in order."""
    stated = lambda v: F.coalesce(_collectivity(v), F.when(type_key(v).isin(*OTHER_TYPES), "Autre"))
    told = lambda found: F.get(F.filter(found, lambda c: c.isNotNull()), 0)
    own = F.get(F.filter(ext, lambda e: e["k"].isin("TYPE", "type") & (e["v"] != "")), 0)["v"]
    others = F.filter(ext, lambda e: F.lower(e["k"]).isin(*TYPE_KEYS))
    pairs = F.filter(F.map_entries(description_pairs(description)), lambda e: contains_any(e["key"], TYPE_HINTS))
    places = (
        ("TYPE", stated(own)), ("ExtendedData", told(F.transform(others, lambda e: stated(e["v"])))), ("Description", told(F.transform(pairs, lambda e: stated(e["value"])))),
        ("Description", _collectivity(description)), ("Arborescence KMZ", _collectivity(F.array_join(path, " "))),
    )
    kind = F.coalesce(*(c for _, c in places), F.lit(UNKNOWN_TYPE))
    return kind, F.coalesce(*(F.when(c.isNotNull(), s) for s, c in places), F.lit(UNKNOWN_SOURCE))


def locality_type(haystack: Column, code: Column) -> tuple[Column, Column]:
    """Type and the reason for it: a word of the (normalised) haystack, the code, a code of several digits."""
    words = (("quartier", "Quartier"), ("camp", "Camp"), ("cite", "Cité"), ("village", "Village"))
    names = F.create_map(*(F.lit(x) for pair in LOCALITY_CODES.items() for x in pair))
    code = F.coalesce(code, F.lit(""))
    digits = F.filter(F.split(code, ""), lambda d: d != "")
    single = F.try_element_at(names, code)
    labels = F.transform(digits, lambda d: F.try_element_at(names, d))
    composite = (F.size(digits) > 0) & F.forall(labels, lambda x: x.isNotNull())
    kind = reason = None
    for word, label in words:
        kind = F.when(haystack.contains(word), label) if kind is None else kind.when(haystack.contains(word), label)
        why = F.lit(f"mot-cle {word}")
        reason = F.when(haystack.contains(word), why) if reason is None else reason.when(haystack.contains(word), why)
    kind = kind.when(single.isNotNull(), single)
    reason = reason.when(single.isNotNull(), F.concat(F.lit("code TYPE="), code))
    for label in LOCALITY_PRIORITY:
        here = composite & F.array_contains(F.array_compact(labels), label)
        kind, reason = kind.when(here, label), reason.when(here, F.concat(F.lit("code TYPE composite="), code))
    return kind.otherwise("Autre"), reason.otherwise(F.concat(F.lit("code TYPE non documente="), F.coalesce(F.nullif(code, F.lit("")), F.lit("vide"))))
