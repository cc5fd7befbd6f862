"""Operators on small frames: normalisers, imports, matching, trees, streams."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralith.functions import text as t
from terralith.operators import decision, hierarchy, match, upsert
from terralith.operators import quality as q
from terralith.streaming import events


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (t.alnum_key, " Équateur-1 ", "EQUATEUR1"), (t.staging_key, "N’djili_Mai-Ndombe", "N'DJILI MAI NDOMBE"), (t.staging_key, None, ""),
        (t.token, "Kasaï Oriental!", "KASAI_ORIENTAL"), (t.token, "", "INCONNU"), (t.token, None, "INCONNU"), (t.group_key, "Mai-Ndombe_x", "MAI NDOMBE X"),
        (t.ascii_key, "Équateur 好", "equateur"), (t.ascii_token, "--Mai  Ndombe--", "MAI_NDOMBE"), (t.province_key, "Mai-Ndombe_Sud", "mai-ndombe sud"),
        (t.city_token, "Çà Â", "ÇA_A"), (t.territory_key, "Éa_b", "ea b"), (t.display_key, " É ", "e"), (t.description_key, "É  à", "e a"),
        (t.clean_code, "503101.000", "503101"), (t.clean_code, "abc", None), (t.compact_code, " a 1 ", "A1"), (t.lenient_int, "12.9", 12), (t.lenient_int, "x", 0),
        (t.lenient_float, "1,5", 1.5), (t.lenient_float, "nan", None), (t.zone_code, "Zone OUEST", "OT"), (t.zone_code, "x", None), (t.slug, "Éa  B!", "ea-b"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_zero_fill_never_cuts(spark):
    assert one(spark, "12345", lambda c: t.zero_fill(c, 3)) == "12345" and one(spark, "7", lambda c: t.padded_code(c, 3)) == "007" and one(spark, "7.0", lambda c: t.padded_code(c, 3)) == "007"


def test_first_truthy(spark):
    df = spark.createDataFrame([("", 0, "a"), (None, 5, "b")], "x string, y int, z string")
    assert [r[0] for r in df.select(t.first_truthy("x", "y", "z")).collect()] == ["a", "5"]


def test_description_pairs(spark):
    assert one(spark, "<b>Chef lieu</b>: Bunia<br/>É = 1<br>x", t.description_pairs) == {"chef lieu": "Bunia", "e": "1"}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aÉè ï-_'’1Z", max_size=8), min_size=1, max_size=20))
def test_normalizers_are_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    stable = ["alnum_key", "staging_key", "type_key", "group_key", "ascii_key", "province_key", "display_key", "token"]
    row = df.select(*(F.coalesce(F.bool_and(t.NORMALIZERS[n](t.NORMALIZERS[n]("x")).eqNullSafe(t.NORMALIZERS[n]("x"))), F.lit(True)).alias(n) for n in stable)).first()
    assert all(row)


def test_upsert(spark):
    staged = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "", "z"), (4, "B", "new"), (5, "C", "same")], "ord int, code string, nom string")
    existing = spark.createDataFrame([("B", "old"), ("C", "same"), ("D", "d")], "code string, nom string")
    plan = upsert.planned_actions(staged, existing, "code", ["nom"])
    assert [(r["action"], r["reason"]) for r in plan.orderBy("ord").collect()] == [("insert", None), ("reject", "Doublon dans le fichier"), ("reject", "code manquant"), ("update", None), ("unchanged", None)]
    assert sorted(tuple(r) for r in upsert.apply_changes(existing, plan, "code").collect()) == [("A", "x"), ("B", "new"), ("C", "same"), ("D", "d")]
    with pytest.raises(ValueError):
        upsert.strict(plan)
    again = upsert.planned_actions(staged.filter("ord in (1, 4, 5)"), upsert.apply_changes(existing, plan, "code"), "code", ["nom"])
    assert {r["action"] for r in again.collect()} == {"unchanged"}


def test_matching_is_what_all_pairs_give(spark):
    import difflib

    rows = [(i, f"e{i}", "groupement", c, n, p) for i, (c, n, p) in enumerate([("G1", "LEMBA", "a"), ("G1", "LEMBA", "b"), ("G1", "LEMBO", "a"), ("G2", "X", "a"), (None, "LEMBA", "a"), ("G2", "LONG NAME", "a")])]
    got = {(r["left_id"], r["right_id"]): r["confidence"] for r in match.candidate_pairs(spark.createDataFrame(rows, "ord int, id string, entity_type string, code string, name string, parent string")).collect()}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            ratio = difflib.SequenceMatcher(None, a[4], b[4]).ratio()
            score = 0.7 * (a[3] is not None and a[3] == b[3]) + (0.25 if ratio >= 0.92 else 0.15 if ratio >= 0.82 else 0) + 0.05 * (a[5] == b[5])
            if round(score, 2) >= 0.6:
                want[(a[1], b[1])] = min(round(score, 2), 0.99)
    assert got == want


def test_cascade(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None)], "id int, s double")
    b = spark.createDataFrame([(3, 9.0), (4, 1.0)], "id int, s double")
    assert [r["id"] for r in decision.cascade(a, b, [F.col("s").desc_nulls_last(), F.col("id")], 3).orderBy("source_rank", F.col("s").desc_nulls_last()).collect()] == [1, 2, 3]


def test_three_valued_filters(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    assert df.filter(decision.is_false("c")).count() == 1 and df.filter(decision.is_true("c")).count() == 1
    assert decision.coverage_filter("6G") is None and decision.clamped_page(45, 20, 9) == 3 and decision.clamped_page(0, 20, 1) == 1


def test_cascade_delete(spark):
    top = spark.createDataFrame([("p1",), ("p2",)], "k string")
    low = spark.createDataFrame([("t1", "p1"), ("t2", "p2")], "k string, p string")
    leaf = spark.createDataFrame([("v1", "t1"), ("v2", "t2")], "k string, p string")
    out = hierarchy.cascade_delete([("top", top, "k", None), ("low", low, "k", "p"), ("leaf", leaf, "k", "p")], spark.createDataFrame([("p1",)], "key string"))
    assert {n: [r[0] for r in d.collect()] for n, d in out.items()} == {"top": ["p2"], "low": ["t2"], "leaf": ["v2"]}


def test_field_dictionary(spark):
    df = spark.createDataFrame([(1, "1", "a"), (2, "", "b"), (3, "2.5", "a"), (4, None, None)], "ord int, n string, s string")
    got = {r["field"]: (r["value_count"], r["unique_count"], r["null_count"], r["example"], r["kind"]) for r in q.field_dictionary(df, "ord").collect()}
    assert got == {"n": (2, 2, 2, "1", "float"), "s": (3, 2, 1, "a", "str")}
    assert [r["value"] for r in q.first_values(df, "ord", "s", 3).collect()] == ["a", "b"]


def test_stream_counts_agree_with_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, event_type string, value double"
    stream = events.window_counts(events.read_stream(spark, str(tmp_path / "in"), schema), late="0 seconds")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counted").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.window_counts(src).collect()}
    assert got == want and got


def test_numbering_in_stretches_is_row_number(spark):
    from pyspark.sql import Window

    from terralith.operators.windows import numbered_within

    rows = [(k, v, i) for i, (k, v) in enumerate([("a", x * x) for x in range(300)] + [("b", 5)] * 4 + [(None, None), (None, 1), ("c", None), ("c", -3), ("a", 10**12)])]
    df = spark.createDataFrame(rows, "k string, v long, i int")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
    got = numbered_within(df, ["k"], ["v", "i"], "n", 16)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == len(rows)
    assert numbered_within(df.limit(0), ["k"], ["v"], "n").count() == 0


def test_preorder_is_the_sort_of_paths(spark):
    paths = [["z"], ["z", "a"], ["z", "a", "x"], ["z", "a b"], ["z", "a", "y"], ["y"], ["y", None], ["z", "é"]]
    got = {tuple(r["path"]): r["position"] for r in hierarchy.preorder(spark.createDataFrame([(p,) for p in paths], "path array<string>")).collect()}
    assert got == {("z",): 1, ("z", "a"): 2, ("z", "a", "x"): 3, ("z", "a", "y"): 4, ("z", "a b"): 5, ("z", "é"): 6, ("y",): 1, ("y", None): 2}


def test_classes_give_all_pairs(spark):
    rows = [(i, f"e{i}", "t", c, n, p) for i, (c, n, p) in enumerate([("A", "x", None), ("A", "x", None), ("A", "y", "q"), ("A", "y", "q"), ("A", None, "q"), (None, "x", None), ("B", "x", None)])]
    df = spark.createDataFrame(rows, "ord int, id string, entity_type string, code string, name string, parent string")
    member = {r["id"]: r["class_id"] for r in match.membership(df).collect()}
    assert member == {"e0": "e0", "e1": "e0", "e2": "e2", "e3": "e2", "e4": "e4", "e6": "e6"}
    between = {(r["left_id"], r["right_id"]): r["confidence"] for r in match.representative_pairs(df).collect()}
    for r in match.candidate_pairs(df).collect():
        a, b = member[r["left_id"]], member[r["right_id"]]
        assert a == b or between[(a, b)] == r["confidence"]


def test_parents_by_name_skip_the_row_itself(spark):
    columns = "ord int, id string, entity_type string, code string, parent_code string, name_key string, province_key string, territory_key string"
    rows = [(i, f"p{i}", "province", None, None, "ITURI", "", "") for i in range(5)] + [(9, "t", "territoire", None, None, "DJUGU", "ITURI", ""), (10, "u", "territoire", None, None, "X", "NULLE", "")]
    got = {r["id"]: r["parent_id"] for r in hierarchy.resolve_staging_parents(spark.createDataFrame(rows, columns)).collect()}
    assert got == {f"p{i}": None for i in range(5)} | {"t": "p0", "u": None}


def test_set_null_and_first_errors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, parent string")
    gone = spark.createDataFrame([("a",), ("a",)], "key string")
    assert {tuple(r) for r in upsert.set_null(rows, "parent", gone).collect()} == {(1, None), (2, "b"), (3, None)}
    plan = spark.createDataFrame([(i, "reject" if i % 2 else "insert", "x") for i in range(200)], "ord int, action string, reason string")
    assert [r["ord"] for r in upsert.first_errors(plan).collect()] == list(range(1, 101, 2))


def test_repeated_rows_are_written_once(spark):
    staged = spark.createDataFrame([(1, "A", "x"), (1, "A", "x")], "ord int, code string, nom string")
    existing = spark.createDataFrame([], "code string, nom string")
    plan = upsert.planned_actions(staged, existing, "code", ["nom"])
    assert upsert.apply_changes(existing, plan, "code").count() == 1
