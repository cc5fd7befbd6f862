"""Decision, search, page and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.text import zone_code
from terralith.operators import decision as op
from terralith.operators.hierarchy import chain
from terralith.operators.quality import missing_fields
from terralith.operators.search import build
from terralith.plans.tables import LOCALITIES_SQL, localities, order_profiles, read
from terralith.scratch import folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"""WITH {LOCALITIES_SQL}
SELECT l.id, nom, zone, province, population, couverture_4g, activite_principale, score_priorite,
       CASE WHEN score_priorite IS NULL THEN 'score_priorite' ELSE '' END AS a_completer
FROM localities l LEFT JOIN profiles p ON p.localite_id = l.id
WHERE population > 3000 AND couverture_4g IS FALSE AND activite_principale ILIKE '%b%'
ORDER BY score_priorite DESC NULLS LAST, nom, l.id LIMIT 100""")
def decision_priority_localities(spark: SparkSession, d: str) -> DataFrame:
    joined = localities(spark, d).join(order_profiles(spark, d), F.col("id") == F.col("localite_id"), "left")
    found = op.all_of(joined, F.col("population") > 3000, op.is_false("couverture_4g"), op.ilike_any(["activite_principale"], "b"))
    missing = F.array_join(missing_fields(["population", "couverture_4g", "score_priorite"]), ",")
    return op.ranked(found, "score_priorite", "nom", "id", 100).select("id", "nom", "zone", "province", "population", "couverture_4g", "activite_principale", "score_priorite", missing.alias("a_completer"))


@query("""WITH t AS (
  SELECT n_nationkey AS id, n_name AS nom, r_name AS zone, round(avg(c_acctbal) / 100, 2) AS connectivite, count(c_custkey) AS localites
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
  WHERE r_name = 'ASIA' GROUP BY ALL)
SELECT * FROM t WHERE connectivite <= 60 ORDER BY connectivite DESC NULLS LAST, nom, id LIMIT 20""")
def decision_priority_territories(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = (read(spark, d, t) for t in ("region", "nation", "customer"))
    base = chain(region.filter(F.col("r_name") == "ASIA"), [(nation, "r_regionkey", "n_regionkey")])
    joined = base.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    t = joined.groupBy(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nom"), F.col("r_name").alias("zone")).agg(F.round(F.avg("c_acctbal") / 100, 2).alias("connectivite"), F.count("c_custkey").alias("localites"))
    return op.ranked(t.filter(F.col("connectivite") <= 60), "connectivite", "nom", "id", 20)


@query(f"""WITH {LOCALITIES_SQL}, a AS (
  SELECT 0 AS source_rank, id, nom, score_priorite AS score FROM localities JOIN profiles ON localite_id = id
  WHERE (nom ILIKE '%99%' OR activite_principale ILIKE '%zzz%') ORDER BY score DESC NULLS LAST, nom, id LIMIT 30
), b AS (
  SELECT 1 AS source_rank, CAST(n_nationkey AS BIGINT) AS id, n_name AS nom, CAST(NULL AS DOUBLE) AS score FROM nation ORDER BY nom, id LIMIT 30
)
SELECT source_rank, id, nom, score FROM (SELECT *, row_number() OVER (ORDER BY source_rank, score DESC NULLS LAST, nom, id) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE k <= 30""")
def decision_search_cascade(spark: SparkSession, d: str) -> DataFrame:
    joined = localities(spark, d).join(order_profiles(spark, d), F.col("id") == F.col("localite_id"))
    first = joined.filter(op.ilike_any(["nom"], "99") | op.ilike_any(["activite_principale"], "zzz")).select("id", "nom", F.col("score_priorite").alias("score"))
    second = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("nom"), F.lit(None).cast("double").alias("score"))
    return op.cascade(first, second, [F.col("score").desc_nulls_last(), F.col("nom"), F.col("id")], 30).select("source_rank", "id", "nom", "score")


@query("""SELECT 'lineitem' AS niveau, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_parents FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT), CAST(count(DISTINCT c_custkey) AS BIGINT) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT), CAST(count(DISTINCT n_nationkey) AS BIGINT) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'nation', CAST(count(*) AS BIGINT), CAST(count(DISTINCT r_regionkey) AS BIGINT) FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def entity_chain_left(spark: SparkSession, d: str) -> DataFrame:
    levels = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    out = None
    for name, child, parent, key in levels:
        part = chain(read(spark, d, name).select(child), [(read(spark, d, parent).select(key), child, key)], "left").agg(F.lit(name).alias("niveau"), F.count("*").alias("n"), F.countDistinct(key).alias("n_parents"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT c_custkey AS id, c_name AS nom, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE' ORDER BY nom, id""")
def children_by_parent_code(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "customer").join(read(spark, d, "nation").filter(F.col("n_name") == "FRANCE"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"), F.col("n_name").alias("parent")).orderBy("nom", "id")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE CAST(p_partkey AS VARCHAR) = '17' OR p_brand = '17' ORDER BY p_partkey LIMIT 1""")
def lookup_id_or_code(spark: SparkSession, d: str) -> DataFrame:
    return op.lookup(read(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", "p_brand", "17")


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50""")
def page_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return op.page(read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), ["o_orderdate", "o_orderkey"], 50, 25)


@query("""WITH s AS (
  SELECT 'region' AS layer, CAST(r_regionkey AS BIGINT) AS id, r_name AS label, lower(r_name) AS h FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name, lower(n_name) FROM nation
  UNION ALL SELECT 'customer', c_custkey, c_name, lower(concat_ws(' ', c_name, c_mktsegment)) FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, lower(s_name) FROM supplier
  UNION ALL SELECT 'part', p_partkey, p_name, lower(concat_ws(' ', p_name, p_brand, p_type)) FROM part)
SELECT layer, id, label FROM s WHERE contains(h, 'ar')""")
def search_free_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _search_rows(spark, d)
    return rows.filter(F.col("text").contains("ar")).drop("text")


#: What the searches of the layers look through: key, label and further columns.
_SEARCHED = [("region", "r_regionkey", "r_name", []), ("nation", "n_nationkey", "n_name", []), ("customer", "c_custkey", "c_name", ["c_mktsegment"]), ("supplier", "s_suppkey", "s_name", []), ("part", "p_partkey", "p_name", ["p_brand", "p_type"])]


def _search_rows(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for layer, key, name, more in _SEARCHED:
        part = read(spark, d, layer).select(F.lit(layer).alias("layer"), F.col(key).cast("long").alias("id"), F.col(name).alias("label"), op.haystack(name, *more).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


_TERMS = ["ar", "ation", "BUILDING", "steel", "000042", "r#0000", "_%", "zzzz"]


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{layer}' AS layer, CAST({key} AS BIGINT) AS id, {name} AS label, lower(concat_ws(' ', {', '.join([name, *more])})) AS h FROM {layer}" for layer, key, name, more in _SEARCHED) + ") SELECT term, layer, id, label FROM s, (SELECT unnest(" + str(_TERMS) + ") AS term) WHERE contains(h, lower(term))")
def search_trigram_index(spark: SparkSession, d: str) -> DataFrame:
    """Several terms looked up in one index of all layers."""
    index = build(_search_rows(spark, d), ["layer", "id", "label"], F.col("text"), folder(spark, "index"), parts=8, buckets=32)
    out = None
    for term in _TERMS:
        part = index.search(term).select(F.lit(term).alias("term"), "layer", "id", "label")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 25 OFFSET (SELECT greatest(count(*) - 100, 0) FROM lineitem)""")
def page_far_from_start(spark: SparkSession, d: str) -> DataFrame:
    """A page shortly before the end, from pages made once."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    pages = op.Pages(rows, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return pages.at(max(pages.total - 100, 0), 25)


@query("""SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
WHERE contains(lower(p_name), '3') OR contains(lower(p_brand), '3') OR contains(lower(p_type), '3') OR contains(CAST(p_size AS VARCHAR), '3')""")
def any_column_filter(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return part.filter(op.any_column_contains(["p_name", "p_brand", "p_type", "p_size"], "3"))


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS rang
FROM orders""")
def custom_rank_order(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("o_orderpriority") == "1-URGENT", "critique").when(F.col("o_orderpriority") == "2-HIGH", "haute").when(F.col("o_orderpriority") == "3-MEDIUM", "normale")
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", op.priority_rank(names).alias("rang"))
    return rows.orderBy("rang", "o_orderkey")


@query("""SELECT n_name, CAST(row_number() OVER (ORDER BY lower(strip_accents(n_name)), n_name) AS INTEGER) AS position FROM nation""")
def locale_sort(spark: SparkSession, d: str) -> DataFrame:
    """Nation names and their place in French collation."""
    from pyspark.sql import Window

    names = read(spark, d, "nation").select("n_name")
    return names.withColumn("position", F.row_number().over(Window.orderBy(F.collate("n_name", "fr"), "n_name"))).select(F.col("n_name"), "position")


@query("""SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand""")
def distinct_options(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_brand").dropna().distinct().orderBy("p_brand")


@query("""SELECT r_name, CASE WHEN contains(lower(r_name), 'nord') THEN 'ND' WHEN contains(lower(r_name), 'ouest') THEN 'OT' WHEN contains(lower(r_name), 'centre') THEN 'CE' WHEN contains(lower(r_name), 'sud') THEN 'SD' WHEN contains(lower(r_name), 'est') THEN 'ET' END AS code
FROM (SELECT r_name FROM region UNION ALL SELECT * FROM (VALUES ('Zone Ouest'), ('ZONE EST'), ('Centre'), ('nord-est'), ('Sud'), ('')) v(r_name))""")
def zone_label_case(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame([("Zone Ouest",), ("ZONE EST",), ("Centre",), ("nord-est",), ("Sud",), ("",)], "r_name string")
    return read(spark, d, "region").select("r_name").unionByName(more).select("r_name", zone_code("r_name").alias("code"))
