"""Operators for hot groups, far pages and indexed search: the same rows as the plain forms, bounded ranges."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terralith import scratch
from terralith.operators import attach, decision, hierarchy, match, search, windows


def sets(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows in one group, an outlier of 10^12, null keys, null orders and null values."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", None, f"k{i % 90}"]), None if i % 97 == 0 else 10**12 if i == 33 else rnd.randrange(5000), i, rnd.choice([None, None, None, i])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, v long, i int, x int").repartition(5)


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_two_levels_agree_with_windows(spark, hot, many):
    order = ["v", "i"]
    over = Window.partitionBy("k").orderBy(*order)
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for most in (0, 200, 1 << 20):
        got = windows.carry_forward(hot, F.col("x"), "c", ["k"], order, hot=most)
        assert sets(got) == sets(hot.withColumn("c", F.last("x", ignorenulls=True).over(upto)))
        got = windows.first_seen(hot, ["k"], order, row="i", hot=most)
        assert sets(got) == sets(hot.withColumn("occurrence", F.row_number().over(over)).withColumn("first_row", F.first("i").over(over)))
        got = windows.numbered_within(hot, ["k"], order, "n", hot=most)
        assert sets(got) == sets(hot.withColumn("n", F.row_number().over(over)))
    assert sets(windows.repeated(hot, ["k"])) == sets(hot.withColumn("n_same", F.count("*").over(Window.partitionBy("k"))))
    for f in (lambda df: windows.carry_forward(df, F.col("x"), "c", ["k"], order, hot=0), lambda df: windows.first_seen(df, ["k"], order, hot=0), lambda df: windows.repeated(df, ["k"])):
        assert f(hot.limit(0)).collect() == []


def test_no_window_over_a_hot_group(spark, hot, many):
    """The plan's windows take the stretch into their partitions, but for the one over stretches."""
    plan = windows.carry_forward(hot, F.col("x"), "c", ["k"], ["v", "i"], hot=200)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line]
    assert len(over) == 2 and sum("_stretch" in line for line in over) == 1 and sum("[_g0" in line for line in over) == 1


def test_ranges_hold_about_as_many_rows(spark, many):
    """One outlier of 10^12, a hot group and a hot branch: no range has more than four times the mean."""
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.when(F.col("id") == 7, 10**12).otherwise(F.col("id")).alias("v"))
    branch = df.select(F.array(F.lit("a"), F.lit("b"), F.col("v").cast("string")).alias("path"))
    for rows, order in ((df, ["k", "v"]), (df, ["v"]), (branch, ["path"])):
        sizes = [r["count"] for r in scratch.ranged(rows, order).groupBy("_stretch").count().collect()]
        assert sum(sizes) == 40_000 and len(sizes) > 8 and max(sizes) <= 4 * sum(sizes) / len(sizes)


def test_scratch_goes_when_it_is_dropped(spark, monkeypatch):
    import os

    monkeypatch.setattr(scratch, "_MADE", {})
    table = scratch.written(spark.range(10).withColumn("p", (F.col("id") % 3).cast("int")), "p")
    made = [p.removeprefix("file://") for p in scratch._MADE[spark.sparkContext.applicationId]]
    assert table.columns == ["id", "p"] and table.filter("p = 1").count() == 3 and len(made) == 1 and os.path.isdir(made[0])
    assert scratch.drop(spark) == 1 and not os.path.exists(made[0]) and scratch.drop(spark) == 0


def test_preorder_of_a_hot_branch(spark, many):
    rnd = random.Random(1)
    paths = sorted({("z",) + tuple(rnd.choice("abcé ") for _ in range(rnd.randrange(0, 5))) for _ in range(400)} | {("y",), ("y", "q")})
    tree = spark.createDataFrame([(list(p),) for p in paths], "path array<string>")
    for most in (0, 1 << 20):
        got = {tuple(r["path"]): r["position"] for r in hierarchy.preorder(tree, hot=most).collect()}
        for top in "yz":
            mine = sorted((p for p in paths if p[0] == top), key=lambda p: [x.encode() for x in p])
            assert [got[p] for p in mine] == list(range(1, len(mine) + 1))


def test_pages(spark, hot, many):
    order = ["v", "i"]
    pages = decision.Pages(hot, order)
    assert pages.total == 3000
    for skip, limit in ((0, 10), (1490, 25), (2990, 25), (3000, 5), (5, 0), (0, 4000)):
        want = hot.orderBy(*order).offset(skip).limit(limit).collect()
        assert pages.at(skip, limit).collect() == want
    assert pages.at(10**9, 1).collect() == []
    plan = pages.at(2500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_page_range" in plan or "PartitionFilters: [(_page_range" in plan
    assert len({r["f"] for r in pages.at(2500, 10).select(F.input_file_name().alias("f")).collect()}) <= 2
    assert decision.Pages(hot.limit(0), order).at(0, 5).collect() == []


def test_trigram_index(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abcABCé %_🙂") for _ in range(rnd.randrange(0, 40)))) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "ab"), (5003, "kinshasa"), (5003, "kinshasa"), (5004, "Ville de KINSHASA centre")]
    rows += [(6000 + i, "the common phrase") for i in range(800)]
    df = spark.createDataFrame(rows, "id int, text string")
    index = search.build(df, ["id"], F.col("text"), str(tmp_path / "index"), parts=8, buckets=16)
    again = search.TextIndex(spark, str(tmp_path / "index"))
    for term in ["kinshasa", "KINshasa", "abc", "a", "", "ab", "%_", "%__", "é a", "bca a", "🙂🙂", "🙂a ", "zzz", "kinshasaa", "common", "b🙂c", "aaaa"]:
        want = sorted(i for i, t in rows if t is not None and term.lower() in t.lower())
        assert sorted(r["id"] for r in index.search(term).collect()) == want, term
    assert [r["id"] for r in again.search("kinshasa").collect()].count(5003) == 2


def test_a_search_reads_few_texts(spark, tmp_path):
    """The plan of a rare term filters the folders of texts; postings are read by bucket."""
    df = spark.range(4000).select("id", F.concat(F.lit("row number "), F.col("id").cast("string"), F.when(F.col("id") == 77, F.lit(" needle")).otherwise(F.lit(""))).alias("text"))
    index = search.build(df, ["id"], F.col("text"), str(tmp_path / "i"), parts=16, buckets=32)
    hits = index.search("needle")
    assert [r["id"] for r in hits.collect()] == [77]
    scans = [line for line in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert any("_part" in s.split("PartitionFilters: ")[1].split("]")[0] for s in scans) and any("_bucket" in s.split("PartitionFilters: ")[1].split("]")[0] for s in scans)
    assert len(set(index.rarest("row number 77"))) == search.PROBES and index.rarest("nothing here") is None


def test_attach_and_reports(spark):
    level = attach.Level
    t = spark.createDataFrame([(1, "Aru", "P1"), (2, "Aru", "P2"), (9, "aru ", "P2")], "id int, nom string, province string")
    c = spark.createDataFrame([(10, "Nord", "P1", "Aru"), (11, "Nord", "P2", "Aru"), (12, "Perdu", "P3", "Aru"), (13, None, "P1", "Aru")], "id int, nom string, province string, territoire string")
    g = spark.createDataFrame([(20, "G", "P1", "Aru", "Nord"), (21, "G", "P3", "Aru", "Perdu")], "id int, nom string, province string, territoire string, collectivite string")
    leaves = spark.createDataFrame([(100, "P1", "Aru", "Nord", "G"), (101, "P2", "ARU", "Nord", "G"), (102, "P1", "Aru", "Absent", "G"), (103, "P3", "Aru", "Perdu", "G"), (104, "P1", "Aru", None, "G"), (105, None, None, None, None), (106, "P1", "Aru", " ", None)], "id int, province string, territoire string, collectivite string, groupement string")
    nodes = attach.kept_nodes([level("territoire", t, ("province",)), level("collectivite", c, ("province", "territoire")), level("groupement", g, ("province", "territoire", "collectivite"))])
    assert {(r["level"], r["id"]) for r in nodes.collect()} == {("territoire", 1), ("territoire", 9), ("collectivite", 10), ("collectivite", 11), ("collectivite", 13), ("groupement", 20)}
    places = {"groupement": ("province", "territoire", "collectivite", "groupement"), "collectivite": ("province", "territoire", "collectivite"), "territoire": ("province", "territoire")}
    got = attach.attached(leaves, nodes, places)
    assert {r["id"]: (r["parent_level"], r["parent_id"]) for r in got.collect()} == {100: ("groupement", 20), 101: ("collectivite", 11), 102: ("territoire", 1), 103: (None, None), 104: ("territoire", 1), 105: (None, None), 106: ("territoire", 1)}
    assert {r["id"]: r["reason"] for r in attach.unattached(got, places).collect()} == {103: "groupement introuvable: p3|aru|perdu|g", 105: "aucun parent nommé"}
    assert {r["key"]: r["n"] for r in attach.child_counts(got, 2).collect()}["p1|aru"] == 4
    ids = attach.ids_under_parents([level("territoire", t.select("id", "nom")), level("collectivite", c, ("territoire",))])
    assert {r["id"]: r["parent_id"] for r in ids["collectivite"].collect()} == {10: 9, 11: 9, 12: 9, 13: 9}


def test_ratio_bound_never_lies_below_the_ratio(spark):
    import difflib

    rnd = random.Random(4)
    names = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(0, 9))) for _ in range(120)] + ["kinshasa", "kinshassa", None]
    df = match.with_bag(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.i") < F.col("b.i")).select(F.col("a.name").alias("x"), F.col("b.name").alias("y"), match.ratio_bound(F.col("a.bag"), F.col("b.bag")).alias("bound"))
    far = 0
    for x, y, bound in pairs.collect():
        assert bound >= difflib.SequenceMatcher(None, x or "", y or "").ratio() - 1e-9
        far += bound < match.SIMILAR
    assert far > 0.8 * len(names) * (len(names) - 1) / 2  # what never reaches Python


def test_a_hot_code_meets_in_blocks(spark, many):
    rnd = random.Random(9)
    rows = [(i, i, "t", "hot" if i % 3 == 0 else f"c{i % 40}", rnd.choice(["kinshasa", "kinshassa", "goma", None]), rnd.choice(["p", None])) for i in range(240)]
    df = spark.createDataFrame(rows, "ord int, id int, entity_type string, code string, name string, parent string")
    assert sets(match.candidate_pairs(df, block=7)) == sets(match.candidate_pairs(df))
    left, right = match.in_blocks(df, ["entity_type", "code"], 7)
    sizes = [r["count"] for side in (left, right) for r in side.groupBy("code", "_i", "_j").count().collect()]
    assert max(sizes) <= 3 * 7 and left.filter("code = 'hot'").select("_i", "_j").distinct().count() > 50


def _crowd(spark):
    """Codes that many share, repeated ids, names near in one order only, null names, parents and orders."""
    rnd = random.Random(5)
    names = ["kinshasa", "kinshassa", "kinshasha", "goma", "amog", "", None, "aaaabbbbcccc", "aaaabbbbcccd", "tide", "diet"]
    rows = [(None if i % 61 == 0 else i - i % 7, i - i % 7, rnd.choice(["t", "t", None]), rnd.choice(["hot", "hot", "a", None]), rnd.choice(names), rnd.choice(["p", "q", None])) for i in range(300)]
    return spark.createDataFrame(rows, "ord long, id long, entity_type string, code string, name string, parent string").repartition(5)


@pytest.mark.parametrize("hot", [1 << 20, 10])
def test_pair_totals_are_what_the_pairs_count_up_to(spark, many, hot):
    df = _crowd(spark)
    pairs = match.candidate_pairs(df).groupBy("confidence", "reasons").agg(F.count("*").alias("n"), F.min("left_id").alias("first_left"), F.sum(F.col("right_id") - F.col("left_id")).alias("spread"))
    want = sets(pairs)
    assert len(want) == 6 and sets(match.pair_totals(df, block=4, hot=hot)) == want
    assert match.pair_totals(df.limit(0)).count() == 0


def test_totals_ask_once_for_two_names(spark):
    """2000 entities of one code with two near names: two million pairs, two ratios at most."""
    rows = spark.range(2000).select(F.col("id").alias("ord"), "id", F.lit("t").alias("entity_type"), F.lit("c").alias("code"), F.when(F.col("id") % 2 == 0, "kinshasa").otherwise("kinshassa").alias("name"), F.lit(None).cast("string").alias("parent"))
    asked = match.near_names(rows)
    assert sorted((r["name"], r["other"], r["level"]) for r in asked.collect()) == [("kinshasa", "kinshassa", 2), ("kinshassa", "kinshasa", 2)]
    got = match.pair_totals(rows).collect()
    assert [(r["confidence"], r["n"], r["first_left"]) for r in got] == [(0.95, 1999000, 0)] and got[0]["spread"] == sum(d * (2000 - d) for d in range(2000))


def test_pairs_ask_python_once_for_two_names(spark):
    """79,800 pairs of a code, half of them of near names: Python sees the two names, not the pairs."""
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return a.str.len() / b.str.len() * 0 + 0.85

    rows = spark.range(400).select(F.col("id").alias("ord"), "id", F.lit("t").alias("entity_type"), F.lit("c").alias("code"), F.when(F.col("id") % 2 == 0, "kinshasa").otherwise("kinshassa").alias("name"), F.lit(None).cast("string").alias("parent"))
    got = match.candidate_pairs(rows, ratio).groupBy("confidence").count().collect()
    assert {r["confidence"]: r["count"] for r in got} == {0.95: 39800, 0.85: 40000} and 0 < asked.value <= 4


def test_pairs_are_dealt_out_by_what_meets(spark):
    """24,000 rows are little to shuffle, and 72 million pairs of rows."""
    rows = spark.range(24000).select(F.lit("t").alias("entity_type"), (F.col("id") % 8).cast("string").alias("code"), "id")
    assert min(side.rdd.getNumPartitions() for side in match.in_blocks(rows, ["entity_type", "code"], 4096)) >= 30


def test_best_pairs_sort_numbers_only(spark, many):
    df = _crowd(spark).withColumn("id", F.monotonically_increasing_id())
    got = match.best_pairs(df, block=7, joined=True)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in match.best_first(match.candidate_pairs(df)).withColumn("reasons", F.array_join("reasons", "; ")).collect()]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "code identique" in plan.split("Sort [")[0] and "code identique" not in plan.split("Sort [")[1]
