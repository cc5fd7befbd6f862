"""Readers and writers on files made here."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terralith import sources
from terralith.operators import geometry as g
from terralith.sources import geojson, kml, shapefile, sinks, tabular, xlsx


def workbook(sheets):
    """sheets: {name: rows of cells}; text by shared strings, numbers as they are."""
    shared, parts = [], {}
    for i, rows in enumerate(sheets.values(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            for c, v in enumerate(row):
                if v is None:
                    continue
                ref = f"{chr(65 + c)}{r}"
                if isinstance(v, str):
                    body += f'<c r="{ref}" t="s"><v>{len(shared)}</v></c>'
                    shared.append(v)
                else:
                    body += f'<c r="{ref}"><v>{v}</v></c>'
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="m"><sheetData><row>{body}</row></sheetData></worksheet>'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="m" xmlns:r="{r}"><sheets>{names}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_xlsx_carry_forward(spark, tmp_path):
    from terralith.operators.windows import carry_forward

    path = tmp_path / "s.xlsx"
    path.write_bytes(workbook({"NORD": [["N°", "PROVINCE", "CODE"], [1, "Kinshasa", None], [None, None, "A1"], [2, "Kwilu", None], [None, None, "B1"]], "SUD": [["N°", "PROVINCE", "CODE"], [None, None, "C1"]]}))
    cells = xlsx.read_cells(spark, str(path))
    heads = {(r["sheet"], r["row"]) for r in xlsx.header_rows(cells, ["N°", "PROVINCE", "CODE"]).collect()}
    assert heads == {("NORD", 1), ("SUD", 1)}
    rows = xlsx.read_table(spark, str(path), {"B": "province", "C": "code"})
    filled = carry_forward(rows, F.col("province"), "p", ["file", "sheet"], ["row"]).filter("code IS NOT NULL").orderBy("sheet_ord", "row")
    assert [(r["code"], r["p"]) for r in filled.collect()] == [("A1", "Kinshasa"), ("B1", "Kwilu"), ("C1", None)]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Code;Nom du site\nA1;"x; ""y"""\n;\nB2;z\n')
    df = sources.read(spark, str(path))
    found = tabular.detect_columns(df.columns, {"code": ["code"], "nom": ["site", "nom site"]})
    assert found == {"code": "Code", "nom": "Nom du site"}
    assert [tuple(r) for r in tabular.rename(df, found).orderBy("code").collect()] == [("A1", 'x; "y"'), ("B2", "z")]
    out = str(tmp_path / "out")
    sinks.write_csv(tabular.rename(df, found).coalesce(1), out)
    assert [tuple(r) for r in tabular.read_csv(spark, out, ";").orderBy("code").collect()] == [("A1", 'x; "y"'), ("B2", "z")]
    assert tabular.missing_columns(df, ["Code", "Zone"]) == ["Zone"]
    mapped = tabular.mapped(df, {"c": {"from": ["Nope", "Code"], "default": "-", "transform": F.lower}, "d": {"from": ["Nope"], "default": "q"}})
    assert sorted(tuple(r) for r in mapped.collect()) == [("a1", "q"), ("b2", "q")]


def test_headers():
    assert tabular.detect_columns(["", "x"], {"code": ["code"]}) == {}
    assert tabular.detect_sheet(["A", "02_Provinces"], "provinces") == "02_Provinces" and tabular.detect_sheet(["A", "B"], "c") is None


def test_zones(spark):
    text = 'zones:\n  - code: ND\n    nom: Nord\n    couleur: "#1"\n    provinces:\n      - Ituri\n      - Nord-Kivu\n  - code: SD\n    nom: Sud\n    provinces:\n      - Lualaba\n'
    rows = tabular.zone_table(spark, text, "v1").select("code", "province").collect()
    assert [tuple(r) for r in rows] == [("ND", "Ituri"), ("ND", "Nord-Kivu"), ("SD", "Lualaba")]


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"folder": "Sites Télécom", "kpi": 3}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "s.geojson").write_text(json.dumps(doc))
    (tmp_path / "bad.geojson").write_text("{}")
    rows = {(r["file"].rsplit("/", 1)[1], r["ord"]): r for r in geojson.read_features(spark, str(tmp_path)).collect()}
    assert rows[("s.geojson", 0)]["folder"] == "Sites Télécom" and rows[("s.geojson", 0)]["properties"] == {"folder": "Sites Télécom", "kpi": "3"}
    assert rows[("s.geojson", 1)]["folder"] == "s" and rows[("bad.geojson", None)]["error"]
    level = spark.createDataFrame([("cod_admin1",), ("x",)], "l string").select(geojson.layer_level(F.col("l"))).collect()
    assert [r[0] for r in level] == ["province", "unknown"]


def test_dbf(tmp_path):
    fields = [(b"NOM", 6), (b"N", 3)]
    head = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15 for n, size in fields) + b"\r"
    records = b" abc   1  " + b"*del   2  " + b" xyz   3  "
    data = b"\x03\0\0\0" + struct.pack("<IHH", 3, 32 + len(head), 10) + b"\0" * 20 + head + records
    assert shapefile.dbf_rows(data) == [{"NOM": "abc", "N": "1"}, {"NOM": "xyz", "N": "3"}]


def test_kml_errors(spark, tmp_path):
    (tmp_path / "a.kmz").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    rows = kml.read_placemarks(spark, str(tmp_path / "a.kmz")).collect()
    assert len(rows) == 1 and rows[0]["error"]
    with pytest.raises(sources.FormatNotSupported):
        sources.read(spark, "x.doc")


def test_geometry(spark):
    df = spark.createDataFrame([("0,0,5 1,0 1,1 0,0",), ("0,0 1,x 1,1",), ("",)], "t string").withColumn("p", g.parse_coordinates(F.col("t")))
    got = [tuple(r) for r in df.select(F.size("p"), g.ring_closed(F.col("p")), F.to_json(g.flat(F.col("p")))).collect()]
    assert got[0] == (4, True, "[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]") and got[1][0] == 2 and got[2][0] == 0
    feature = spark.range(1).select(g.point_feature(F.lit(1.0), F.lit(2.0), nom=F.lit("a")).alias("feature"))
    assert json.loads(sinks.feature_collection(feature))["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert "&amp;&lt;" in spark.range(1).select(sinks.placemark(F.lit("&<"), F.lit(1.0), F.lit(2.0))).first()[0]
    assert sinks.markdown_table(spark.range(2)).splitlines() == ["| id |", "| --- |", "| 0 |", "| 1 |"]


def test_missing_reports_and_unread_formats(spark, tmp_path):
    from terralith import sources
    from terralith.sources.geojson import read_records

    assert read_records(spark, str(tmp_path / "none.json"), "rows", "nom string").count() == 0
    with pytest.raises(Exception):
        read_records(spark, str(tmp_path / "none.json"), "rows").count()
    (tmp_path / "r.json").write_text('{"rows": [{"nom": "a"}]}')
    assert read_records(spark, str(tmp_path / "r.json"), "rows", "nom string").first()["nom"] == "a"
    assert sources.explore(spark, "x/a.gpkg")[1:] == (None, ["gpkg: format connu, non lu"])
    assert sources.explore(spark, "x/a")[1] is None and sources.explore(spark, str(tmp_path / "r.json"))[0] == "json"


def _shp_record(number, body):
    return struct.pack(">2i", number, len(body) // 2) + body


def _rings(kind, rings):
    points = [p for r in rings for p in r]
    starts, at = [], 0
    for r in rings:
        starts.append(at)
        at += len(r)
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def test_shapes(spark, tmp_path):
    outer, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    far = [(9, 9), (9, 10), (10, 10), (9, 9)]
    bodies = [struct.pack("<i2d", 1, 1.5, 2), struct.pack("<i", 0), struct.pack("<i3d", 11, 3, 4, 5), _rings(3, [outer]), _rings(3, [outer, far]), _rings(5, [outer, hole]), _rings(5, [outer, hole, far])]
    bodies.append(struct.pack("<i4di", 8, 0, 0, 0, 0, 2) + struct.pack("<4d", 1, 2, 3, 4))
    data = b"\0" * 100 + b"".join(_shp_record(i + 1, b) for i, b in enumerate(bodies))
    (tmp_path / "a.shp").write_bytes(data)
    (tmp_path / "b.shp").write_bytes(b"\0" * 100)
    rows = {r["ord"]: (r["geometry_type"], json.loads(r["geometry"])["coordinates"]) for r in shapefile.read_shapes(spark, str(tmp_path / "*.shp")).collect()}
    lists = lambda ring: [list(map(float, p)) for p in ring]
    assert rows[0] == ("Point", [1.5, 2.0]) and 1 not in rows and rows[2] == ("Point", [3.0, 4.0])
    assert rows[3] == ("LineString", lists(outer)) and rows[4] == ("MultiLineString", [lists(outer), lists(far)])
    assert rows[5] == ("Polygon", [lists(outer), lists(hole)]) and rows[6] == ("MultiPolygon", [[lists(outer), lists(hole)], [lists(far)]])
    assert rows[7] == ("MultiPoint", [[1.0, 2.0], [3.0, 4.0]]) and len(rows) == 7


def test_dbf_keeps_record_numbers():
    head = b"N".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([2]) + b"\0" * 15 + b"\r"
    data = b"\x03\0\0\0" + struct.pack("<IHH", 2, 32 + len(head), 3) + b"\0" * 20 + head + b"*1 " + b" 2 "
    assert shapefile.dbf_records(data) == [(1, {"N": "2"})]


def test_broken_documents_give_no_geometry_and_no_style(spark, tmp_path):
    (tmp_path / "a.kml").write_text('<kml><Document><Style id="s"><LineStyle><color>ff</color></LineStyle></Style><Placemark/><Placemark><MultiGeometry/><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>')
    (tmp_path / "b.kml").write_text("<kml>")
    found = [tuple(r)[1:] for r in kml.read_geometries(spark, str(tmp_path / "*.kml")).collect()]
    assert found == [(1, "Point", '{"type":"Point","coordinates":[1.0,2.0]}')]
    assert [tuple(r)[1:] for r in kml.resolved_styles(spark, str(tmp_path / "*.kml")).collect()] == [("#s", "ff", None)]


# --- streams and committed writers ---------------------------------------------------------------------


def test_large_files_are_read_as_streams(spark, tmp_path):
    from terralith.sources import kml, xlsx

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Tout</name><Style id="s"><LineStyle><color>ff00</color></LineStyle></Style>'
    marks = "".join(f"<Folder><name>F{i % 7} é</name><Placemark><name>p{i}</name><ExtendedData><Data name='K'><value>{i}</value></Data></ExtendedData><Point><coordinates>{i},1,2</coordinates></Point></Placemark></Folder>" for i in range(5000))
    (tmp_path / "a b%20é.kml").write_text(head + "</Document></kml>")
    assert kml.read_placemarks(spark, str(tmp_path / "a b*.kml"), streamed=0).count() == 0
    (tmp_path / "a.kml").write_text("﻿" + head + marks + "</Document></kml>", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "b.kmz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.png", b"no")
        z.writestr("doc.kml", head + marks + "</Document></kml>")
    for name in ("a.kml", "b.kmz"):
        whole = kml.read_placemarks(spark, str(tmp_path / name)).orderBy("ord").collect()
        streamed = kml.read_placemarks(spark, str(tmp_path / name), streamed=0).orderBy("ord").collect()
        assert whole == streamed and len(whole) == 5000 and whole[4]["path"] == ["Tout", "F4 é"] and whole[4]["ext"][0]["v"] == "4"
        assert kml.read_geometries(spark, str(tmp_path / name), streamed=0).count() == 5000
        assert [r["line_color"] for r in kml.resolved_styles(spark, str(tmp_path / name)).collect()] == ["ff00"]


def test_memory_of_a_large_document_is_bounded(tmp_path):
    """40 MB of KML: what the parser holds stays far below the size of the document."""
    import tracemalloc

    from terralith.sources import kml

    one = "<Placemark><name>n</name><description>" + "x" * 900 + "</description><Point><coordinates>1,2</coordinates></Point></Placemark>"
    path = tmp_path / "big.kml"
    with path.open("w") as f:
        f.write('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>A</name>')
        for _ in range(40_000):
            f.write(one)
        f.write("</Folder></Document></kml>")
    tracemalloc.start()
    n = 0
    with kml.opened(f"file:{path}", None) as stream:
        for _ in kml.features(stream):
            n += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and most < 4_000_000


def test_a_fault_gives_an_error_row(spark, tmp_path):
    from terralith.sources import kml

    (tmp_path / "bad.kml").write_text("<kml><Document><Placemark><name>a</name></Placemark><oops></Document></kml>")
    rows = kml.read_placemarks(spark, str(tmp_path / "bad.kml")).collect()
    assert [(r["ord"], r["name"]) for r in rows if r["error"] is None] == [(0, "a")] and sum(r["error"] is not None for r in rows) == 1
    assert kml.read_geometries(spark, str(tmp_path / "bad.kml")).count() == 0


def test_committed_documents_round_trip(spark, tmp_path):
    import json

    from terralith.sources import committed, kml, sinks, xlsx

    df = spark.range(0, 2500, 1, 3).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.format_string("a < b & é %d", "id")).alias("nom"), (F.col("id") / 4).alias("x"), F.lit("2024-01-02").cast("date").alias("d"), F.array(F.lit(1)).alias("l"))
    marks = df.select(sinks.placemark(F.col("nom"), F.col("id").cast("double"), F.lit(1.5)).alias("placemark"))
    committed.write(marks, str(tmp_path / "k"), "kml", "C & <A>", most_rows=400)
    files = sorted(p.name for p in (tmp_path / "k").iterdir())
    assert len(files) == 10 and files[0] == "doc.kml" and not any("staging" in f for f in files)
    assert all(f in (tmp_path / "k/doc.kml").read_text() for f in files[1:])
    back = kml.read_placemarks(spark, str(tmp_path / "k/part-*"))
    assert back.filter("error IS NOT NULL").count() == 0 and {r["name"] for r in back.collect()} == {r["nom"] or "" for r in df.collect()} and back.count() == 2500
    committed.write(df, str(tmp_path / "w"), "xlsx", "Feuille/1", most_rows=1000)
    cells = xlsx.read_table(spark, str(tmp_path / "w/*.xlsx"), {"A": "id", "B": "nom", "C": "x", "D": "d", "E": "l"})
    want = {(str(r["id"]), r["nom"], repr(r["x"]), "2024-01-02", "[1]") for r in df.collect()}
    assert {tuple(r) for r in cells.select("id", "nom", "x", "d", "l").collect()} == want and cells.count() == 2500
    committed.write(df, str(tmp_path / "j"), "json", most_rows=10_000)
    held = [r for p in (tmp_path / "j").glob("part-*") for r in json.loads(p.read_text())["rows"]]
    assert len(held) == 2500 and json.loads((tmp_path / "j/manifest.json").read_text())["rows"] == 2500
    with pytest.raises(Exception, match="already"):
        committed.write(df, str(tmp_path / "j"), "json")
    committed.write(df.limit(3), str(tmp_path / "j"), "json", overwrite=True)
    assert json.loads((tmp_path / "j/manifest.json").read_text())["rows"] == 3 and len(list((tmp_path / "j").glob("part-*"))) == 1
    sources.write(df.limit(5).coalesce(1).withColumn("nom", F.lit("a|b\\c\nd")), str(tmp_path / "m"), "md", name="Rapport")
    text = next((tmp_path / "m").glob("part-*.md")).read_text()
    assert text.startswith("# Rapport\n\n| id | nom | x | d | l |\n| --- |") and "| 0 | a\\|b\\\\c<br>d | 0.0 | 2024-01-02 | [1] |" in text and len(text.splitlines()) == 9
    with pytest.raises(sources.FormatNotSupported):
        sources.write(df, str(tmp_path / "x"), "doc")
    committed.write(df.limit(0), str(tmp_path / "e"), "json")
    assert [p.name for p in (tmp_path / "e").iterdir()] == ["manifest.json"]


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    from terralith.sources import committed

    df = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        committed.write(df, str(tmp_path / "f"), "json")
    assert not (tmp_path / "f").exists() or list((tmp_path / "f").iterdir()) == []


# --- databases -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    """Derby, embedded in Spark's jars, with a skewed table, one without rows and one of a single key."""
    url = "jdbc:derby:memory:terralith;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    key = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, 10**12).otherwise(F.col("id"))
    rows = spark.range(3000).select(key.cast("long").alias("K"), F.col("id").alias("ID"), F.concat(F.lit("n"), F.col("id")).alias("NOM")).coalesce(2)
    rows.write.jdbc(url, "SITES", "overwrite", options)
    rows.limit(0).write.jdbc(url, "VIDE", "overwrite", options)
    rows.limit(20).withColumn("K", F.lit(5).cast("long")).write.jdbc(url, "SEUL", "overwrite", options)
    return url, options, rows


def test_jdbc_ranges_of_a_skewed_key(spark, derby):
    url, options, rows = derby
    got = sources.read_jdbc(spark, url, "SITES", "K", 8, **options)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    # a third of the rows have one key, which is one range; the others stay near the mean whatever the outlier
    assert 4 <= len(sizes) <= 9 and sorted(sizes)[-2] < 2.5 * 3000 / 8
    assert got.rdd.getNumPartitions() <= 8


def test_jdbc_odd_tables_and_pushdown(spark, derby):
    url, options, _ = derby
    assert sources.read_jdbc(spark, url, "VIDE", "K", 4, **options).collect() == []
    assert sources.read_jdbc(spark, url, "SEUL", "K", 4, **options).count() == 20
    assert sources.read_jdbc(spark, url, "SITES", **options).count() == 3000
    plan = sources.read_jdbc(spark, url, "SITES", "K", 4, **options).filter("NOM = 'n5'").select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(NOM), *EqualTo(NOM,n5)]" in plan and "ReadSchema: struct<ID:bigint>" in plan
