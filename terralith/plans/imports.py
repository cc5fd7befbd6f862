"""Import, de-duplication, code and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions import text as t
from terralith.operators import upsert as u
from terralith.operators.windows import carry_forward, first_seen, numbered_codes
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


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' OR event_type = 'login' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def carry_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type").isin("signup", "login"), F.col("event_id"))
    return carry_forward(read(spark, d, "events"), value, "carried", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "carried")


@query("""SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS occurrence, first_value(event_id) OVER w AS first_row, CASE WHEN row_number() OVER w > 1 THEN 'Doublon' END AS reason FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def first_seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = first_seen(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], row="event_id")
    return rows.select("event_id", "occurrence", "first_row", F.when(F.col("occurrence") > 1, "Doublon").alias("reason"))


@query("""WITH b AS (SELECT c_custkey, 'SITE_' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || '_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS prefix FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY c_custkey) + CASE WHEN prefix = 'SITE_00_000' THEN 7 ELSE 0 END AS n FROM b)
SELECT c_custkey, prefix || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS code FROM k""")
def site_code_sequence(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    prefix = F.concat_ws("_", F.lit("SITE"), t.zero_fill("n_regionkey", 2), t.zero_fill("n_nationkey", 3))
    existing = spark.createDataFrame([("SITE_00_000_007",), ("SITE_00_000_002",)], "code string")
    return numbered_codes(joined.select("c_custkey", "n_regionkey", "n_nationkey"), prefix, ["c_custkey"], existing).select("c_custkey", "code")


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as staged rows: some with blank or repeated codes, changed names, unknown parents; every third exists."""
    key = F.col("c_custkey")
    staged = read(spark, d, "customer").select(key.alias("ord"), F.when(key % 17 == 0, "").when(key % 13 == 0, "DUP").otherwise(F.concat(F.lit("K"), key)).alias("code"), F.when(key % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")).alias("nom"), F.when(key % 11 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).cast("string").alias("parent"))
    existing = read(spark, d, "customer").filter(key % 3 == 0).select(F.concat(F.lit("K"), key).alias("code"), F.col("c_name").alias("nom"), F.col("c_nationkey").cast("string").alias("parent"))
    return staged, existing, read(spark, d, "nation").select("n_nationkey")


_STAGED_SQL = """s AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'DUP' ELSE 'K' || c_custkey END AS code, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS nom,
  CASE WHEN c_custkey % 11 = 0 THEN '99' ELSE CAST(c_nationkey AS VARCHAR) END AS parent FROM customer),
e AS (SELECT 'K' || c_custkey AS code, c_name AS nom, CAST(c_nationkey AS VARCHAR) AS parent FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT s.*, e.code AS old, e.nom AS old_nom, e.parent AS old_parent, CASE WHEN s.code = '' THEN 'code manquant' WHEN row_number() OVER (PARTITION BY s.code ORDER BY ord) > 1 THEN 'Doublon dans le fichier' WHEN n_nationkey IS NULL THEN 'Parent inconnu' END AS reason
  FROM s LEFT JOIN e ON s.code = e.code LEFT JOIN nation ON s.parent = CAST(n_nationkey AS VARCHAR)),
planned AS (SELECT ord, code, nom, parent, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN old IS NULL THEN 'insert' WHEN nom IS DISTINCT FROM old_nom OR parent IS DISTINCT FROM old_parent THEN 'update' ELSE 'unchanged' END AS action, reason FROM r)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    staged, existing, parents = _staged(spark, d)
    return u.planned_actions(staged, existing, "code", ["nom", "parent"], parents, "parent", ("nom",))


@query(f"WITH {_STAGED_SQL} SELECT * FROM planned")
def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(f"WITH {_STAGED_SQL} SELECT action, reason, CAST(count(*) AS BIGINT) AS n FROM planned GROUP BY ALL")
def import_preview(spark: SparkSession, d: str) -> DataFrame:
    return u.preview(_plan(spark, d))


@query(f"WITH {_STAGED_SQL}, w AS (SELECT code, nom, parent FROM planned WHERE action IN ('insert', 'update')) SELECT * FROM w UNION ALL SELECT * FROM e WHERE code NOT IN (SELECT code FROM w)")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return u.apply_changes(_staged(spark, d)[1], _plan(spark, d), "code")


@query(f"WITH {_STAGED_SQL} SELECT DISTINCT parent AS name, 'AUTO_' || upper(substr(md5(parent), 1, 8)) AS code FROM s WHERE parent NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def auto_create_parents(spark: SparkSession, d: str) -> DataFrame:
    staged, _, parents = _staged(spark, d)
    return u.missing_parents(staged, parents.select(F.col("n_nationkey").cast("string").alias("n")), "parent", "n")


@query(f"WITH {_STAGED_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT CASE WHEN code NOT IN (SELECT code FROM e) THEN code END) AS BIGINT) AS ignored FROM s")
def skip_if_exists(spark: SparkSession, d: str) -> DataFrame:
    staged, existing, _ = _staged(spark, d)
    new, old = u.skip_existing(existing, staged, "code", "ord")
    return new.select(F.lit(0).alias("o")).unionByName(old.select(F.lit(1).alias("o"))).agg(F.count("*").alias("n"), F.sum("o").alias("ignored"))


@query("""WITH a AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 1)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_name <> b.p_name AND a.p_size <> b.p_size THEN 'modified' WHEN a.p_size <> b.p_size THEN 'geometry' ELSE 'attributes' END AS change,
  CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p_name <> b.p_name THEN 'p_name' END, CASE WHEN a.p_size <> b.p_size THEN 'p_size' END) END AS fields
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name <> b.p_name OR a.p_size <> b.p_size""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    part, key = read(spark, d, "part").select("p_partkey", "p_name", "p_size"), F.col("p_partkey")
    after = part.filter(key % 10 != 1).select("p_partkey", F.when(key % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), F.when(key % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return u.snapshot_diff(part.filter(key % 10 != 0), after, "p_partkey", ["p_name", "p_size"], "p_size").withColumn("fields", F.array_join("fields", ","))


@query("""WITH s AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'propose' ELSE 'valide' END AS status, CASE WHEN quality = 0 THEN '2024-01-01' END AS validated_at FROM labels), x AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'accept' END AS decision FROM labels WHERE doc_id % 2 = 0)
SELECT id, CASE WHEN status = 'propose' AND decision = 'accept' THEN 'valide' WHEN status = 'propose' AND decision = 'reject' THEN 'rejete' ELSE status END AS status,
  CASE WHEN status = 'propose' AND decision = 'accept' THEN '2025-01-01' WHEN status = 'propose' AND decision = 'reject' THEN NULL ELSE validated_at END AS validated_at, CASE WHEN status = 'propose' AND decision IS NOT NULL THEN 'a' END AS validated_by FROM s LEFT JOIN x ON id = doc_id""")
def enrichment_transitions(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels")
    good = F.col("quality") == 1
    rows = labels.select(F.col("doc_id").alias("id"), F.when(good, u.PROPOSED).otherwise(u.VALIDATED).alias("status"), F.when(~good, "2024-01-01").alias("validated_at"), F.lit(None).cast("string").alias("validated_by"))
    asked = labels.filter(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "reject").otherwise("accept").alias("decision"), F.lit("a").alias("by"))
    return u.transitions(rows, asked, F.lit("2025-01-01"))


_NAMES = ["  Équateur ", "Mai-Ndombe", "Kasaï  Oriental", "BAS_UELE", "", "Çà et là", "n 12"]


@query("""WITH n AS (SELECT n_name AS x FROM nation UNION ALL SELECT * FROM (VALUES ('  Équateur '), ('Mai-Ndombe'), ('Kasaï  Oriental'), ('BAS_UELE'), (''), ('Çà et là'), ('n 12')) v(x)), a AS (SELECT x, strip_accents(x) AS s FROM n)
SELECT x, regexp_replace(upper(trim(s)), '[^A-Z0-9]', '', 'g') AS alnum_key, trim(regexp_replace(translate(upper(trim(s)), '-_', '  '), '\\s+', ' ', 'g')) AS staging_key,
  lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS type_key, coalesce(nullif(regexp_replace(translate(upper(trim(s)), '- ', '__'), '[^A-Z0-9_]', '', 'g'), ''), 'INCONNU') AS token,
  upper(trim(regexp_replace(translate(s, '-_', '  '), '\\s+', ' ', 'g'))) AS group_key, replace(upper(trim(regexp_replace(translate(s, '-_', '  '), '\\s+', ' ', 'g'))), ' ', '_') AS group_token,
  lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS ascii_key, upper(trim(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS ascii_token,
  trim(regexp_replace(replace(lower(trim(s)), '_', ' '), '\\s+', ' ', 'g')) AS province_key,
  regexp_replace(translate(translate(upper(trim(x)), 'ÉÈÊÀÂ', 'EEEAA'), '- ', '__'), '[^\\p{L}\\p{N}_]', '', 'g') AS city_token,
  trim(regexp_replace(replace(translate(lower(x), 'éèêàâ', 'eeeaa'), '_', ' '), '\\s+', ' ', 'g')) AS territory_key, lower(trim(s)) AS display_key,
  translate(lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))), 'éèà', 'eea') AS description_key FROM a""")
def normalizer_suite(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "nation").select(F.col("n_name").alias("x")).unionByName(spark.createDataFrame([(x,) for x in _NAMES], "x string"))
    return names.select("x", *(f("x").alias(name) for name, f in t.NORMALIZERS.items()))


@query("""SELECT c_custkey, nullif(regexp_replace(split_part(trim(CAST(c_custkey AS VARCHAR) || '.000'), '.', 1), '\\D', '', 'g'), '') AS clean, upper(regexp_replace(c_name, '\\s', '', 'g')) AS compact,
  CASE WHEN length(CAST(c_nationkey AS VARCHAR)) < 4 THEN lpad(CAST(c_nationkey AS VARCHAR), 4, '0') ELSE CAST(c_nationkey AS VARCHAR) END AS filled, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(0 AS BIGINT) AS bad FROM customer""")
def code_cleaning(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer")
    return rows.select("c_custkey", t.clean_code(F.concat(F.col("c_custkey").cast("string"), F.lit(".000"))).alias("clean"), t.compact_code("c_name").alias("compact"), t.zero_fill("c_nationkey", 4).alias("filled"), t.lenient_int("c_acctbal").alias("whole"), t.lenient_int("c_name").alias("bad"))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, CAST(length(html) - length(replace(html, '<', '')) AS INTEGER) AS tags, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages""")
def html_description_pairs(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    title = t.collapse(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return pages.select("page_id", title.alias("title"), (F.char_length("html") - F.char_length(F.replace("html", F.lit("<"), F.lit("")))).alias("tags"), host.alias("host"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.plan'), json_extract_string(props, '$.k'), json_extract_string(props, '$.ref'), 'aucun') AS value FROM events""")
def json_property_extract(spark: SparkSession, d: str) -> DataFrame:
    found = [F.get_json_object("props", f"$.{k}") for k in ("plan", "k", "ref")]
    return read(spark, d, "events").select("event_id", F.coalesce(*found, F.lit("aucun")).alias("value"))


@query("""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_sort(list_slice(embedding, 1, 5))[1]::DOUBLE AS least_of_five, CAST(len(list_distinct(embedding)) AS INTEGER) AS n_distinct, list_contains(embedding, embedding[3]) AS has_third FROM embeddings""")
def embedding_array_ops(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.size(e).alias("n"), F.array_sort(F.slice(e, 1, 5))[0].cast("double").alias("least_of_five"), F.size(F.array_distinct(e)).alias("n_distinct"), F.array_contains(e, F.element_at(e, 3)).alias("has_third"))


@query("""SELECT c_custkey, 'Zone ' || r_name || ' > ' || n_name || ' > ' || c_name AS label, '<n>' || replace(replace(c_name, '#', '&amp;#'), '&amp;#', '#') || '</n>' AS xml, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def label_rendering(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    label = t.path_label(F.concat(F.lit("Zone "), "r_name"), F.col("n_name"), F.lit(""), F.col("c_name"))
    return rows.select("c_custkey", label.alias("label"), F.concat(F.lit("<n>"), t.xml_escape("c_name"), F.lit("</n>")).alias("xml"), t.slug("c_name").alias("slug"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def event_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming window counts over the events as a batch."""
    from terralith.streaming.events import window_counts

    return window_counts(read(spark, d, "events")).withColumn("total", F.round("total", 2))


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_acctbal, CASE WHEN s >= 85 THEN 'excellent' WHEN s >= 70 THEN 'bon' WHEN s >= 50 THEN 'moyen' ELSE 'faible' END AS badge, CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'validé' ELSE 'inconnu' END AS state
FROM (SELECT *, least(100, greatest(0, c_acctbal / 100)) AS s FROM customer)""")
def badges_and_states(spark: SparkSession, d: str) -> DataFrame:
    from terralith.operators.decision import score_badge

    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 100))
    word = F.when(F.col("c_mktsegment").contains("BUILD"), "VALIDÉ").otherwise("x")
    return read(spark, d, "customer").select("c_custkey", "c_acctbal", score_badge(score).alias("badge"), t.status_label(word).alias("state"))
