"""Counts, indexes, scores, coverage and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.operators import quality as q
from terralith.operators.hierarchy import members_index, prefix_counts, preorder, tree_rows, visible_nodes, without_children
from terralith.operators.quality import Check
from terralith.operators.windows import repeated
from terralith.plans.tables import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_LEVELS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS niveau, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in _LEVELS))
def summary_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in _LEVELS:
        part = read(spark, d, t).agg(F.lit(t).alias("niveau"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT CAST(count(*) AS BIGINT) AS imports, CAST(count(DISTINCT user_id) AS BIGINT) AS users, coalesce(round(sum(value), 2), 0) AS total, CAST(count_if(value IS NULL) AS BIGINT) AS vides
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def import_history_aggregates(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    as_of = events.agg(F.max("ts").alias("as_of"))
    recent = events.join(F.broadcast(as_of), F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS"))  # one row
    return recent.agg(F.count("*").alias("imports"), F.countDistinct("user_id").alias("users"), F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("total"), F.count_if(F.col("value").isNull()).alias("vides"))


@query("""SELECT r_name AS zone, CAST(count(c_custkey) AS BIGINT) AS n FROM (SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'ATLANTIS') LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def counts_by_level_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """Customers by zone; a zone without any, one that nothing hangs under too, has 0."""
    nation = read(spark, d, "nation")
    per_nation = read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("_n"))
    per_region = nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.sum("_n").alias("_n"))
    zones = read(spark, d, "region").select(F.col("r_regionkey").cast("long"), "r_name").unionByName(spark.createDataFrame([(-1, "ATLANTIS")], "r_regionkey long, r_name string"))
    joined = zones.join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select(F.col("r_name").alias("zone"), F.coalesce("_n", F.lit(0)).alias("n"))


def _part_checks() -> list[Check]:
    return [
        Check("petit", F.col("p_size") < 5, 25, "Taille trop petite", "Vérifier la taille"),
        Check("cher", F.col("p_retailprice") > 1500, 20, "Prix élevé", "Vérifier le prix"),
        Check("marque", F.col("p_brand").endswith("1"), 15, "Marque à revoir", "Corriger la marque"),
    ]


_PART_SQL = "p_size < 5 AS petit, p_retailprice > 1500 AS cher, suffix(p_brand, '1') AS marque"


@query(f"""WITH f AS (SELECT {_PART_SQL} FROM part), a AS (
  SELECT CAST(count(*) AS BIGINT) AS entities, CAST(count_if(petit) AS BIGINT) AS petit, CAST(count_if(cher) AS BIGINT) AS cher, CAST(count_if(marque) AS BIGINT) AS marque FROM f)
SELECT *, round(greatest(0.0, 100.0 - (petit * 25.0 + cher * 20.0 + marque * 15.0) / greatest(entities, 1)), 2) AS score FROM a""")
def conditional_metrics(spark: SparkSession, d: str) -> DataFrame:
    return q.global_score(read(spark, d, "part"), _part_checks())


@query(f"""WITH f AS (SELECT p_partkey, {_PART_SQL} FROM part)
SELECT p_partkey, greatest(0.0, 100.0 - (CASE WHEN petit THEN 25.0 ELSE 0 END + CASE WHEN cher THEN 20.0 ELSE 0 END + CASE WHEN marque THEN 15.0 ELSE 0 END))::DOUBLE AS score,
       concat_ws(',', CASE WHEN petit THEN 'petit' END, CASE WHEN cher THEN 'cher' END, CASE WHEN marque THEN 'marque' END) AS flags FROM f""")
def entity_quality_score(spark: SparkSession, d: str) -> DataFrame:
    checks = _part_checks()
    return read(spark, d, "part").select("p_partkey", q.row_score(checks).alias("score"), F.array_join(q.flags(checks), ",").alias("flags"))


@query(f"""WITH f AS (SELECT p_partkey, {_PART_SQL} FROM part)
SELECT p_partkey, 'petit' AS flag, 'Taille trop petite' AS problem, 'Vérifier la taille' AS suggestion FROM f WHERE petit
UNION ALL SELECT p_partkey, 'cher', 'Prix élevé', 'Vérifier le prix' FROM f WHERE cher
UNION ALL SELECT p_partkey, 'marque', 'Marque à revoir', 'Corriger la marque' FROM f WHERE marque""")
def fact_sheet_flags(spark: SparkSession, d: str) -> DataFrame:
    return q.anomalies(read(spark, d, "part"), _part_checks(), ["p_partkey"])


@query("""SELECT CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS segments, CAST(count(DISTINCT (c_nationkey, c_mktsegment)) AS BIGINT) AS couples FROM customer""")
def coverage_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").agg(F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("c_mktsegment").alias("segments"), F.countDistinct("c_nationkey", "c_mktsegment").alias("couples"))


@query("""WITH t AS (SELECT n_name AS province, CAST(count(c_custkey) AS BIGINT) AS total, CAST(count(c) AS BIGINT) AS found
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders) ON c = c_custkey GROUP BY n_name)
SELECT *, CASE WHEN total > 0 THEN round(100.0::DOUBLE * found / total, 2) ELSE 0 END AS percent,
  CASE WHEN found >= 50 AND 100.0 * found / total >= 75 THEN 'bien couverte' WHEN found = 0 THEN 'absente' WHEN found < 50 OR 100.0 * found / total < 25 THEN 'faible' ELSE 'partielle' END AS band FROM t""")
def coverage_audit_by_province(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "orders").select(F.col("o_custkey").alias("c")).distinct()
    joined = read(spark, d, "customer").join(seen, F.col("c") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count("c").alias("found"))
    rows = read(spark, d, "nation").join(joined, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    rows = rows.select(F.col("n_name").alias("province"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("found", F.lit(0)).alias("found"))
    return rows.select("*", q.percent(F.col("found"), F.col("total")).alias("percent"), q.coverage_band(F.col("found"), F.col("total")).alias("band"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def uncovered_children(spark: SparkSession, d: str) -> DataFrame:
    return without_children(read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders"), "c_custkey", "o_custkey")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("zone"), F.col("n_name").alias("province"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("nom"), "c_custkey")


_PLACED_SQL = "placed AS (SELECT r_name AS zone, n_name AS province, c_mktsegment AS segment, c_name AS nom, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {_PLACED_SQL} SELECT zone, province, segment, CAST(count(*) AS BIGINT) AS n, CAST(3 - (grouping(zone) + grouping(province) + grouping(segment)) AS INTEGER) AS depth FROM placed GROUP BY ROLLUP (zone, province, segment)")
def hierarchy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return prefix_counts(_placed(spark, d), ["zone", "province", "segment"])


@query(f"WITH {_PLACED_SQL} SELECT province, segment, string_agg(nom, ', ' ORDER BY nom) AS members, CAST(count(*) AS BIGINT) AS n FROM placed GROUP BY province, segment")
def group_index_members(spark: SparkSession, d: str) -> DataFrame:
    return members_index(_placed(spark, d), ["province", "segment"], F.col("nom"))


@query("SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - 1 AS BIGINT) AS excess FROM customer GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return q.duplicate_groups(read(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT p_partkey, p_brand, CAST(count(*) OVER (PARTITION BY p_brand, p_size) AS BIGINT) AS n_same, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS duplicate FROM part")
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    return repeated(read(spark, d, "part"), ["p_brand", "p_size"]).select("p_partkey", "p_brand", "n_same", (F.col("n_same") > 1).alias("duplicate"))


@query("SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS n_p_type, CAST(count(DISTINCT p_size) AS BIGINT) AS n_p_size FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1 OR count(DISTINCT p_size) > 1")
def multi_parent_conflict(spark: SparkSession, d: str) -> DataFrame:
    return q.parent_conflicts(read(spark, d, "part"), "p_brand", ["p_type", "p_size"])


@query("""WITH m AS (SELECT 'NATION source=''' || cn.n_name || ''' parent=''' || sn.n_name || '''' AS message, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE cn.n_name <> sn.n_name)
SELECT regexp_extract(message, 'source=''([^'']*)''', 1) AS source, regexp_extract(message, 'parent=''([^'']*)''', 1) AS parent, CAST(count(*) AS BIGINT) AS n, min(l_orderkey) AS first_ord FROM m GROUP BY 1, 2 ORDER BY n DESC, first_ord, source, parent LIMIT 25""")
def mismatch_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation")
    customers = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("_c"))
    suppliers = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("_s"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = lines.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).filter(F.col("_c") != F.col("_s"))
    counts = joined.groupBy("_c", "_s").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_ord"))
    # messages are parsed once a pair, after counting
    message = F.format_string("NATION source='%s' parent='%s'", "_c", "_s")
    pairs = counts.select(F.regexp_extract(message, "source='([^']*)'", 1).alias("source"), F.regexp_extract(message, "parent='([^']*)'", 1).alias("parent"), "n", "first_ord")
    return pairs.orderBy(F.desc("n"), "first_ord", "source", "parent").limit(25)


@query("""WITH e AS (SELECT n_name AS name FROM nation UNION SELECT 'ATLANTIS'), f AS (SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT coalesce(e.name, f.name) AS name, CASE WHEN f.name IS NULL THEN 'manquante' WHEN e.name IS NULL THEN 'inattendue' ELSE 'trouvée' END AS etat FROM e FULL JOIN f ON e.name = f.name""")
def expected_vs_found(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation")
    expected = nation.select(F.col("n_name").alias("e")).union(spark.createDataFrame([("ATLANTIS",)], "e string")).distinct()
    found = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("f")).distinct()
    both = expected.join(found, F.col("e") == F.col("f"), "full_outer")
    return both.select(F.coalesce("e", "f").alias("name"), F.when(F.col("f").isNull(), "manquante").when(F.col("e").isNull(), "inattendue").otherwise("trouvée").alias("etat"))


@query("""WITH l AS (
  SELECT c_custkey AS ord, 'c_name' AS field, trim(c_name) AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', trim(c_mktsegment) FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT field, CAST(count(value) AS BIGINT) AS value_count, CAST(count(DISTINCT value) AS BIGINT) AS unique_count, CAST(count_if(value IS NULL) AS BIGINT) AS null_count, arg_min(value, ord) AS example,
  CASE field WHEN 'c_nationkey' THEN 'int' ELSE 'str' END AS kind FROM l GROUP BY field""")
def field_dictionary(spark: SparkSession, d: str) -> DataFrame:
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), "c_name", "c_mktsegment", "c_nationkey")
    return q.field_dictionary(customer, "ord").drop("examples")


@query("""SELECT source, lang, CAST(count(*) AS BIGINT) AS n, round(100.0::DOUBLE * (count_if(trim(text) <> '') + count_if(n_chars IS NOT NULL)) / (2 * count(*)), 2) AS completeness FROM documents GROUP BY source, lang""")
def folder_catalog_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(100.0 * q.completeness(docs, ["text", "n_chars"]), 2).alias("completeness"))


@query("SELECT event_type, round(avg(value), 2) AS mean_score, CAST(count(value) AS BIGINT) AS n_scores, CAST(floor(avg(value)) AS BIGINT) AS whole_mean FROM events GROUP BY event_type")
def mean_available_scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("mean_score"), F.count("value").alias("n_scores"), F.floor(F.avg("value")).alias("whole_mean"))


@query("""WITH a AS (SELECT count_if(c_acctbal >= 0) * 1.0::DOUBLE / count(*) AS consistency, count(c_mktsegment) * 1.0::DOUBLE / count(*) AS completeness FROM customer),
b AS (SELECT count(DISTINCT o_custkey) * 1.0::DOUBLE / (SELECT count(*) FROM customer) AS coverage FROM orders)
SELECT round(100 * (completeness * 0.35 + consistency * 0.45 + coverage * 0.20), 2) AS national_quality FROM a, b""")
def national_quality_index(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 0).alias("good"), F.count("c_mktsegment").alias("full")).withColumn("k", F.lit(1))
    b = read(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("covered")).withColumn("k", F.lit(1))
    index = F.try_divide(F.col("full"), F.col("n")) * 0.35 + F.try_divide(F.col("good"), F.col("n")) * 0.45 + F.try_divide(F.col("covered"), F.col("n")) * 0.20
    return a.join(b, "k").select(F.round(100 * index, 2).alias("national_quality"))


@query("""WITH u AS (
  (SELECT 'customer' AS source, c_custkey AS id, 'solde négatif' AS problem FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 20)
  UNION ALL (SELECT 'part', p_partkey, 'taille' FROM part WHERE p_size < 3 ORDER BY p_partkey LIMIT 12)
  UNION ALL (SELECT 'supplier', s_suppkey, 'solde négatif' FROM supplier WHERE s_acctbal < 0 ORDER BY s_suppkey LIMIT 5)) SELECT * FROM u""")
def anomaly_union_capped(spark: SparkSession, d: str) -> DataFrame:
    sources = [("customer", "c_custkey", F.col("c_acctbal") < 0, "solde négatif", 20), ("part", "p_partkey", F.col("p_size") < 3, "taille", 12), ("supplier", "s_suppkey", F.col("s_acctbal") < 0, "solde négatif", 5)]
    out = None
    for table, key, failed, problem, most in sources:
        part = read(spark, d, table).filter(failed).orderBy(key).limit(most).select(F.lit(table).alias("source"), F.col(key).alias("id"), F.lit(problem).alias("problem"))
        out = part if out is None else out.unionByName(part)
    return out


_TREE_SQL = f"""{_PLACED_SQL}, t AS (
  SELECT 3 - (grouping(zone) + grouping(province) + grouping(segment)) AS depth, zone, province, segment, CAST(count(*) AS BIGINT) AS n FROM placed GROUP BY ROLLUP (zone, province, segment)),
tree AS (SELECT CAST(depth AS INTEGER) AS depth, CASE depth WHEN 1 THEN zone WHEN 2 THEN province ELSE segment END AS label, concat_ws(' > ', zone, province, segment) AS path_label,
  CASE WHEN depth = 2 THEN zone WHEN depth = 3 THEN concat_ws(' > ', zone, province) END AS parent_path, n, zone, province, segment FROM t WHERE depth > 0)"""


@query(f"WITH {_TREE_SQL} SELECT depth, label, path_label, parent_path, n, CAST(row_number() OVER (PARTITION BY zone ORDER BY province NULLS FIRST, segment NULLS FIRST) AS INTEGER) AS position FROM tree")
def tree_preorder(spark: SparkSession, d: str) -> DataFrame:
    return preorder(tree_rows(_placed(spark, d), ["zone", "province", "segment"])).drop("path")


@query(f"""WITH {_TREE_SQL} SELECT depth, label, path_label, n FROM tree a WHERE EXISTS (
  SELECT 1 FROM tree b WHERE contains(lower(b.label), 'an') AND (b.path_label = a.path_label OR starts_with(b.path_label, a.path_label || ' > ')))""")
def tree_filter_visible(spark: SparkSession, d: str) -> DataFrame:
    tree = tree_rows(_placed(spark, d), ["zone", "province", "segment"])
    return visible_nodes(tree, F.lower("label").contains("an")).select("depth", "label", "path_label", "n")


@query("""WITH g AS (SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s), v AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT g.lang, g.source, coalesce(CAST(n AS BIGINT), 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE 100 END AS completeness, CASE WHEN n IS NULL THEN 'Non renseigné' ELSE 'Renseigné' END AS state FROM g LEFT JOIN v ON g.lang = v.lang AND g.source = v.source""")
def section_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    values = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    # the grid of sections: all values of each of two short dimensions, from one pass
    lists = docs.agg(F.collect_set("lang").alias("_l"), F.collect_set("source").alias("_s"))
    grid = lists.select(F.explode("_l").alias("lang"), "_s").select("lang", F.explode("_s").alias("source"))
    joined = grid.join(values, ["lang", "source"], "left")
    empty = F.col("n").isNull()
    return joined.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.when(empty, 0).otherwise(100).alias("completeness"), F.when(empty, "Non renseigné").otherwise("Renseigné").alias("state"))


@query("""WITH c AS (SELECT lang, source, round(100.0::DOUBLE * count_if(n_chars >= 2000) / count(*), 2) AS completeness FROM documents GROUP BY ALL)
SELECT lang, source, completeness, CASE WHEN completeness < 25 THEN 'critique' WHEN completeness < 45 THEN 'haute' ELSE 'normale' END AS priority, CASE WHEN completeness < 25 THEN 0 WHEN completeness < 45 THEN 1 ELSE 2 END AS rang FROM c""")
def completeness_priorities(spark: SparkSession, d: str) -> DataFrame:
    from terralith.operators.decision import priority_rank

    rows = read(spark, d, "documents").groupBy("lang", "source").agg(F.round(100.0 * F.count_if(F.col("n_chars") >= 2000) / F.count("*"), 2).alias("completeness"))
    name = F.when(F.col("completeness") < 25, "critique").when(F.col("completeness") < 45, "haute").otherwise("normale")
    return rows.withColumn("priority", name).withColumn("rang", priority_rank(F.col("priority")))


@query("""SELECT niveau, compteur, valeur FROM (
  SELECT 'customer' AS niveau, 'total' AS compteur, CAST(count(*) AS BIGINT) AS valeur FROM customer UNION ALL SELECT 'customer', 'sans_commande', CAST(count_if(NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS BIGINT) FROM customer
  UNION ALL SELECT 'part', 'total', CAST(count(*) AS BIGINT) FROM part UNION ALL SELECT 'part', 'doublons', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_size HAVING count(*) > 1))""")
def registry_counters(spark: SparkSession, d: str) -> DataFrame:
    from terralith.sources.sinks import union_ragged

    customer, part = read(spark, d, "customer"), read(spark, d, "part")

    def counter(df: DataFrame, level: str, name: str, value) -> DataFrame:
        return df.agg(F.lit(level).alias("niveau"), F.lit(name).alias("compteur"), value.alias("valeur"))

    idle = without_children(customer, read(spark, d, "orders"), "c_custkey", "o_custkey")
    twice = q.duplicate_groups(part, ["p_brand", "p_size"])
    return union_ragged([counter(customer, "customer", "total", F.count("*")), counter(idle, "customer", "sans_commande", F.count("*")), counter(part, "part", "total", F.count("*")), counter(twice, "part", "doublons", F.coalesce(F.sum("excess"), F.lit(0)))])


@query("""SELECT e.niveau, expected, CAST(coalesce(n, 0) AS BIGINT) AS found, CAST(coalesce(n, 0) - expected AS BIGINT) AS gap FROM (VALUES ('AFRICA', 5), ('ASIA', 7), ('ATLANTIS', 1)) e(niveau, expected)
LEFT JOIN (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) ON r_name = niveau""")
def reference_count_gap(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("AFRICA", 5), ("ASIA", 7), ("ATLANTIS", 1)], "niveau string, expected int")
    found = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    joined = expected.join(found, F.col("niveau") == F.col("r_name"), "left")
    return joined.select("niveau", "expected", F.coalesce("n", F.lit(0)).alias("found"), (F.coalesce("n", F.lit(0)) - F.col("expected")).alias("gap"))
