"""Odd rows of import previews, structure sheets and children by layer."""

from terralith.operators import intake as i

ALL = {"nom": "nom", "province": "province", "territoire": "territoire", "collectivite": "coll", "latitude": "lat", "longitude": "lon"}
SCHEMA = "ligne long, nom string, province string, territoire string, coll string, lat string, lon string"


def test_anomalies(spark):
    rows = [(2, "A", "P", None, None, "1,5", "2"), (3, " a ", "p", "", None, "x", "2"), (4, None, " ", None, "C", "99", "1"), (5, "B", None, None, "C", None, None), (6, "B", None, None, None, "91", "0"), (7, "D", "P", "T", None, "5", None)]
    found = sorted(tuple(r)[:2] for r in i.import_anomalies(spark.createDataFrame(rows, SCHEMA), ALL, "ligne").collect())
    assert found == [("coordonnees_invalides", 3), ("coordonnees_invalides", 6), ("coordonnees_invalides", 7), ("doublons_probables", 3), ("doublons_probables", 6), ("sans_rattachement", 6)]
    empty = spark.createDataFrame([], SCHEMA)
    assert i.import_anomalies(empty, ALL, "ligne").count() == 0
    assert i.import_anomalies(empty, {}, "ligne").count() == 4


def test_previews_of_an_empty_table(spark):
    found = i.value_preview(spark.createDataFrame([], SCHEMA), "ligne", ["nom", "lat"]).collect()
    assert sorted((r["field"], r["examples"]) for r in found) == [("lat", []), ("nom", [])]


def test_children(spark):
    zones = spark.createDataFrame([("Nord", "N", "1"), ("Sud", "", "2")], "nom string, zone_fdsu string, code string")
    provinces = spark.createDataFrame([("a", "N"), ("b", "1"), ("c", "2"), ("d", ""), ("e", None)], "nom string, zone_fdsu string")
    found = sorted(tuple(r) for r in i.children_by_layer("zones", zones, {"provinces": provinces}).collect())
    assert found == [("Nord", "provinces", "a"), ("Nord", "provinces", "b"), ("Sud", "provinces", "c")]
    assert i.children_by_layer("villages", zones, {}).count() == 0


def test_structure_sheets(spark):
    schema = "sheet_ord int, row int, zone string, province_code string, province_name string, territory_code string, territory_name string, sites long"
    rows = [(0, 0, "ND", "ND", None, None, None, None), (0, 1, "ND", None, None, "9", "lost", 1), (0, 2, "ND", "01", "Nord", "1", "Un", 3), (0, 3, "ND", None, None, "1", "Un bis", 4), (0, 4, "ND", None, None, "2", "Deux", None), (0, 5, "ND", None, None, "2", "Deux", 8), (0, 6, "ND", None, "", None, " ", None), (1, 0, "SD", None, None, "7", "other sheet", 1)]
    sheets = spark.createDataFrame(rows, schema)
    kinds = {(r["sheet_ord"], r["row"]): r["kind"] for r in i.structure_rows(sheets).collect()}
    assert kinds == {(0, 0): "ignored", (0, 1): "error", (0, 2): "taken", (0, 3): "taken", (0, 4): "taken", (0, 5): "repeated", (0, 6): "ignored", (1, 0): "error"}
    provinces = spark.createDataFrame([("01", "Nord", "SD")], "code string, nom string, zone string")
    territories = spark.createDataFrame([("01", "2", "Deux", None), ("02", "1", "Un bis", 4)], "province string, code string, nom string, sites long")
    above, below = i.structure_plan(sheets, provinces, territories)
    assert [tuple(r) for r in above.collect()] == [("01", "Nord", "ND", "update")]
    assert sorted(tuple(r) for r in below.collect()) == [("01", "1", "Un bis", 4, "insert"), ("01", "2", "Deux", 0, "unchanged")]
