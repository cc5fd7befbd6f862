"""Referentials on small archives built here: counts, parents, zones, scores."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from terralith.plans import referentials as r
from terralith.sources import kml

SQUARE = "<Polygon><outerBoundaryIs><LinearRing><coordinates>29,1 30,1 30,2 29,2 29,1</coordinates></LinearRing></outerBoundaryIs></Polygon>"
POINT = "<Point><coordinates>29.5,1.5,0</coordinates></Point>"


def placemark(name, ext, geometry=SQUARE, description=""):
    data = "".join(f'<Data name="{k}"><value>{v}</value></Data>' for k, v in ext.items())
    label = f"<name>{name}</name>" if name else ""
    return f"<Placemark>{label}<description>{description}</description><ExtendedData>{data}</ExtendedData>{geometry}</Placemark>"


def kmz(groups):
    """groups: (path, placemarks)"""
    body = ""
    for path, marks in groups:
        body += "".join(f"<Folder><name>{p}</name>" for p in path) + "".join(marks) + "</Folder>" * len(path)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("doc.kml", f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Document</name>{body}</Document></kml>')
    return out.getvalue()


@pytest.fixture
def read(spark, tmp_path):
    def run(*groups):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.kmz"
        path.write_bytes(kmz(groups))
        return kml.read_placemarks(spark, str(path)).cache()

    return run


def rows(df):
    return [x.asDict(recursive=True) for x in df.orderBy("ord").collect()]


def test_provinces(spark, read):
    marks = [placemark("Kinshasa", {"CODE_OFFICIEL": "11", "CHEF_LIEU": "Kinshasa"}), placemark("Kwilu", {"CODE_OFFICIEL": "31"}, description="<![CDATA[chef lieu: Bandundu<br/>autre: x]]>"), placemark("Objet", {}, POINT)]
    p = read((["Province26", "Provinces officielles"], marks))
    zones = spark.createDataFrame([("OT", "Kinshasa"), ("OT", "Kwilu")], "code string, province string")
    found = rows(r.provinces(p, zones))
    assert [(x["nom"], x["zone"], x["code"], x["chef_lieu"], x["score"]) for x in found] == [("Kinshasa", "OT", "11", "Kinshasa", 100.0), ("Kwilu", "OT", "31", "Bandundu", 100.0)]
    assert r.provinces(p, zones.filter("province = 'Kinshasa'")).count() == 1


def test_territory_and_conflict(spark, read):
    path = ["ZONES", "ZONE EST", "Provinces", "Haut-Uele", "Territoire"]
    ext = {"TYPE": "Territoire", "NOM": "Dungu", "PROVINCE": "Haut-Uele", "ZONE": "EST"}
    good = rows(r.territories(read((path, [placemark("Dungu", ext)]))))
    assert len(good) == 1 and good[0]["zone"] == "ET" and good[0]["chaine"] == ["RDC", "Zone Est", "Haut-Uele", "Dungu"] and good[0]["score"] == 100.0
    bad = rows(r.territories(read((path, [placemark("Dungu", ext | {"PROVINCE": "Ituri"})]))))
    assert bad[0]["incoherences"] == ["province"] and bad[0]["score"] == 85.0


def test_cities(spark, read):
    path = ["ZONES", "ZONE EST", "Provinces", "Nord-Kivu", "Territoires"]
    found = rows(r.cities(read((path, [placemark("Goma", {"TYPE": "Communes"}), placemark("Nyiragongo", {"TYPE": "Territoire"})]))))
    assert [(x["nom"], x["province"], x["zone"], x["geometrie_valide"]) for x in found] == [("Goma", "Nord-Kivu", "ET", True)]


def test_depth_and_last_folder(spark, read):
    """Cities lie exactly six deep and in Territoire(s); territories at least six deep."""
    here = ["ZONES", "ZONE EST", "Provinces", "Nord-Kivu"]
    goma, beni = placemark("Goma", {"TYPE": "Commune"}), placemark("Beni", {"TYPE": "Commune"})
    p = read((here + ["Communes"], [goma]), (here + ["x", "Territoires"], [goma]), (here[1:] + ["Territoires"], [goma]), (here + ["Territoires"], [beni, placemark("", {"TYPE": "Commune", "NOM": "Sans nom"})]))
    assert [x["nom"] for x in rows(r.cities(p))] == ["Beni"]
    assert sorted(x["nom"] for x in rows(r.territories(p))) == ["Beni", "Goma", "Sans nom"]


def test_first_of_several_files(spark, read, tmp_path):
    """The first province of a name is that of the first file, though places restart in each."""
    for i, code in enumerate(("11", "12", "13")):
        (tmp_path / f"p{i}.kmz").write_bytes(kmz([(["P"], [placemark("x", {})] * (3 - i) + [placemark("Kwilu", {"CODE": code})])]))
    zones = spark.createDataFrame([("OT", "Kwilu"), ("EE", "Kwilu")], "code string, province string")
    found = r.provinces(kml.read_placemarks(spark, str(tmp_path / "p*.kmz")), zones).collect()
    assert [(x["code"], x["zone"]) for x in found] == [("11", "EE")]


def test_city_conflict(spark, read):
    goma = placemark("Goma", {"TYPE": "Commune"})
    p = read((["ZONES", "ZONE EST", "Provinces", "Nord-Kivu", "Territoires"], [goma]), (["ZONES", "ZONE OUEST", "Provinces", "Kinshasa", "Territoire"], [goma]))
    one = r.city_quality(r.cities(p)).first()
    assert (one["duplicates"], one["multi_province"], one["multi_zone"], one["score"]) == (1, 1, 1, 65.0)


def test_collectivities(spark, read):
    marks = [placemark("Walendu-Pitsi", {"CODE_INS": "503101.00000000000", "TYPE": "Secteur"}), placemark("Bahema-Nord", {"CODE_INS": "503102.0", "TYPE": "Chefferie"}), placemark("Bunia", {"CODE_INS": "501001.0", "TYPE": "Commune"})]
    parents = spark.createDataFrame([(1, "Djugu", "Ituri", "ET", "5031")], "ord long, nom string, province string, zone string, code string")
    found = rows(r.collectivities(read((["Collectivités", "Zone Est", "Collectivités Ituri"], marks)), parents))
    assert [(x["type"], x["territoire"], x["province"], x["zone"], x["score"]) for x in found] == [("Secteur", "Djugu", "Ituri", "ET", 100.0), ("Chefferie", "Djugu", "Ituri", "ET", 100.0)]


COLLECTIVITY = "ord long, nom string, territoire string, province string, zone string, code string"


def test_groupings(spark, read):
    marks = [placemark("", {"GROUPEMENT": "Bwato", "PCODE": "40520016", "TERRITOIRE": "Yakoma", "COLLECTIV": "Abumombazi", "CODE_GRPT": "40520103"}, POINT), placemark("", {"GROUPEMENT": "Pombi", "PCODE": "40520018", "COLLECTIV": "Nom source divergent", "CODE_GRPT": "40520116"}, POINT)]
    parents = spark.createDataFrame([(1, "Abumombazi", "Yakoma", "Nord-Ubangi", "ND", "405201")], COLLECTIVITY)
    found = r.groupings(read((["Groupements", "Groupement"], marks)), parents)
    got = rows(found)
    assert [x["collectivite"] for x in got] == ["Abumombazi"] * 2 and [len(x["incoherences"]) for x in got] == [0, 1]
    assert r.grouping_quality(found).first()["score"] == 97.5


def test_localities(spark, read):
    marks = [placemark("Bigi", {"PCODE": "40520004", "TYPE": "7", "TERRITOIRE": "Yakoma", "COLLECTIV": "Abumombazi", "GROUPEMENT": "Bwato", "CODE_GRPT": "40520103"}, POINT), placemark("Sans parent", {"PCODE": "99920005", "TYPE": "456", "TERRITOIRE": "Inconnu"}, POINT)]
    c = spark.createDataFrame([(1, "Abumombazi", "Yakoma", "Nord-Ubangi", "ND", "405201")], COLLECTIVITY)
    g = spark.createDataFrame([(1, "Bwato", "Abumombazi", "Yakoma", "Nord-Ubangi", "ND", "40520103")], "ord long, nom string, collectivite string, territoire string, province string, zone string, code string")
    p = spark.createDataFrame([(1, "Yakoma", "Nord-Ubangi", "ND")], "ord long, nom string, province string, zone string")
    found = r.localities(read((["Localite.kmz", "Localite"], marks)), g, c, p)
    got = rows(found)
    assert [(x["type"], x["groupement"], x["resolution"]) for x in got] == [("Camp", "Bwato", "CODE_GRPT"), ("Cité", None, "non rattaché")]
    assert got[1]["flags"] == ["orphan", "zone"] and got[1]["canonical_id"] == "LOC-PARENT_INCONNU-99920005-SANS_PARENT"
    one = r.locality_quality(found).first()
    assert (one["entities"], one["orphan"], one["unattachable"], one["geometry"], one["coordinates"], one["type"], one["duplicates"]) == (2, 1, 1, 0, 0, 0, 0)
    assert one["score"] == 77.5  # 100 less (25 + 20) / 2
    assert r.locality_indexes(found).agg(F.sum(F.when(F.col("depth") == 1, F.col("n")))).first()[0] == 2


def test_blank_keys_never_join(spark):
    from terralith.operators.resolve import Rule, ordered_fallback_join

    parents = spark.createDataFrame([(1, "", "x"), (2, None, "y")], "ord long, k string, p string")
    df = spark.createDataFrame([("",), (None,)], "k string")
    got = ordered_fallback_join(df, [Rule("k", (F.col("k"),), parents, ("k",), "l")], ["p"]).collect()
    assert {x["resolution"] for x in got} == {"non rattaché"}


def test_published_scores(spark):
    from terralith.operators.quality import GLOBAL_WEIGHTS, penalty_score

    one = spark.createDataFrame([(26710, 924, 924, 0, 0, 43, 665)], "entities long, orphan long, unattachable long, geometry long, coordinates long, type long, duplicates long")
    assert one.select(penalty_score(F.col("entities"), list(GLOBAL_WEIGHTS["localite"].items()))).first()[0] == 98.18


def test_coverage_audit(spark):
    t_ = spark.createDataFrame([("T1", "P1"), ("T2", "P1"), ("T3", "P2")], "nom string, province string")
    c_ = spark.createDataFrame([("C1", "T1", "P1"), ("C2", "T2", "P1"), ("C3", "T3", "P2")], "nom string, territoire string, province string")
    g_ = spark.createDataFrame([("C1", "T1", "P1"), ("C1", "T1", "P1"), (None, None, None)], "collectivite string, territoire string, province string")
    got = {x["province"]: (x["territoires"], x["territoires_couverts"], x["collectivites"], x["couvertes"], x["pourcentage"], x["bande"]) for x in r.coverage_audit(t_, c_, g_).collect()}
    assert got == {"P1": (2, 1, 2, 1, 50.0, "faible"), "P2": (1, 0, 1, 0, 0.0, "absente")}


STAGING = "ord long, id string, raw_name string, raw_code string, type_hint string, parent_code string, zone_code string, province_name string, territory_name string, geometry_type string, geometry string"


def test_staging(spark):
    from terralith.operators import staging as s

    rows = [
        (1, "zone-nd", "Zone ND", None, None, None, "ND", None, None, None, None),
        (2, "prov-kin", "Kinshasa", "P01", "PROVINCE", None, None, "KINSHASA", None, "Polygon", '{"coordinates": [1]}'),
        (3, "ville-kin", "Ville de Kinshasa", "V01", "VILLE", None, None, "KINSHASA", None, None, "{}"),
        (4, "com-gom", "Commune urbaine de Gombe", "C01", "COMMUNE URBAINE", "v01", None, "KINSHASA", None, None, None),
        (5, "grp-1", "Groupement Lemba", "G100", "GROUPEMENT", None, None, None, None, None, None),
        (6, "grp-2", "Groupement-Lemba", "G100", "GROUPEMENT", None, None, None, None, None, None),
    ]
    p = s.prepare(spark.createDataFrame(rows, STAGING)).cache()
    got = {x["id"]: (x["entity_type"], x["parent_id"]) for x in p.collect()}
    assert got["prov-kin"][0] == "province" and got["ville-kin"] == ("ville", "prov-kin") and got["com-gom"] == ("commune_urbaine", "ville-kin") and got["zone-nd"][0] == "zone"
    pairs = s.matches(p).collect()
    assert [(x["left_id"], x["right_id"], x["confidence"]) for x in pairs] == [("grp-1", "grp-2", 0.95)]
    found = {(x["id"], x["issue"]) for x in s.issues(p).collect()}
    assert {("zone-nd", "MISSING_CODE"), ("grp-1", "DUPLICATE_CODE"), ("grp-2", "DUPLICATE_NAME"), ("grp-1", "ORPHAN_ENTITY"), ("ville-kin", "INVALID_GEOMETRY")} <= found and not any(i == "com-gom" for i, _ in found)
    assert {x["level"]: x["actual"] for x in s.count_gaps(p, {"province": 1, "ville": 2}).collect()} == {"ville": 1}
    one = s.statistics(p).first()
    assert one["entities"] == 6 and 0 < one["completeness_rate"] < 1 and one["errors"] == len(found)
    levels = spark.createDataFrame([("adm1",), (" Village",), ("x",), (None,)], "l string").select(s.level_of(F.col("l")), s.level_order(F.col("l"))).collect()
    assert [tuple(x) for x in levels] == [("province", 1), ("village", 5), ("unknown", 99), ("unknown", 99)]


def test_explorer(spark):
    from terralith.operators import explorer

    rows = [(1, "Sites Télécom", "Point", {"province": "A", "site_name": "x", "kpi_score": "3"}), (2, "Sites Télécom", "Point", {"province": "", "site_name": "y", "kpi_score": "4"}), (3, "Vide", None, {})]
    f = spark.createDataFrame(rows, "ord long, folder string, geometry_type string, properties map<string,string>")
    got = {x["folder"]: x for x in explorer.folders(f).collect()}
    sites = got["Sites Télécom"]
    assert sites["object_count"] == 2 and sites["category"] == "Télécommunications" and "KPI" in sites["tags"] and sites["module"] == "Cartographie" and sites["quality"] == 85.0
    assert got["Vide"]["quality"] == 40.0
    d = {x["field"]: (x["value_count"], x["null_count"], x["example"], x["kind"]) for x in explorer.dictionary(f).collect()}
    assert d == {"province": (1, 1, "A", "str"), "site_name": (2, 0, "x", "str"), "kpi_score": (2, 0, "3", "int")}


def test_knowledge(spark):
    from terralith.operators import knowledge

    values = spark.createDataFrame([("Uvira", "Territoire", "population", "300 000 habitants"), ("Uvira", "Territoire", "defis", "Enclavement"), ("Goma", "Ville", "photos", " ")], "entity string, entity_type string, section string, value string")
    full = knowledge.profiles(values)
    assert full.count() == 2 * len(knowledge.SECTIONS) and full.filter("completeness = 100").count() == 2
    got = knowledge.search(values, "enclav").collect()
    assert [(x["entity"], x["matched_fields"], x["excerpt"], x["completeness"]) for x in got] == [("Uvira", ["Défis"], "300 000 habitants", 8)]
    assert knowledge.search(values, "goma").first()["matched_fields"] == ["Présentation"] and knowledge.search(values, " ").count() == 0
