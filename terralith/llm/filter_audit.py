"""What five document filters remove in every order of application, and what each adds to the others.

One pass builds a five-bit mask of failed conditions for every document with native expressions; a grouping by text
gives the least doc_id of equal texts.  A histogram of 32 masks a part holds all that the 120 orders need: what a filter
removes at a step are the masks with its bit and none of the bits before it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import table, text_or_empty

FILTERS = "ABCDE"
_WORDS = r"[^\x20\x09-\x0D]+"


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of a text and its words, but for E (text of a smaller doc_id)."""
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row of docs (doc_id, text, source).

    Null text is empty, null source is the part ''.  A row fails E if a smaller doc_id has the same text; a null doc_id is
    smaller than none and has none smaller, so such rows pass; repeated rows of one id don't fail by each other.  Of
    several labels of an id the greatest holds; labels with null doc_id are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("_text"))
    split = texts.withColumn("_words", F.regexp_extract_all("_text", F.lit(_WORDS), F.lit(0)))
    failed = sum((F.when(c, _bit(k)).otherwise(0) for k, c in conditions(F.col("_text"), F.col("_words")).items()), F.lit(0))
    light = split.select("doc_id", "part", failed.alias("_mask"), F.unhex(F.sha2("_text", 256)).alias("_key"))
    # one row a text, joined by id and text: a large group of copies spreads over its ids
    first = light.groupBy("_key").agg(F.min("doc_id").alias("_first")).select(F.col("_key").alias("_k"), "_first")
    later = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t")).withColumnRenamed("doc_id", "_id")
    rows = light.join(first, (F.col("doc_id") == F.col("_first")) & (F.col("_key") == F.col("_k")), "left").join(known, F.col("doc_id") == F.col("_id"), "left")
    flag = lambda c: F.coalesce((F.col(c) == 1).cast("long"), F.lit(0).cast("long"))
    return rows.select("doc_id", "part", (F.col("_mask") + F.when(later, _bit("E")).otherwise(0)).alias("mask"), flag("_q").alias("good"), flag("_t").alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """One row a part: arrays of 2^5 counts by mask, of all rows (n), of the good and of the toxic ones."""
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by_mask = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(1 << len(FILTERS))))
    return counted.groupBy("part").agg(*(by_mask(c).alias(c) for c in ("n", "good", "toxic")))


def orders() -> Column:
    """All orders of the filters, an array of 120 strings."""
    return F.lit(["".join(p) for p in permutations(FILTERS)])


def _before() -> Column:
    """The bits of the filters that stand before `step` in `filter_order`."""
    return sum((F.when(F.instr("filter_order", f) < F.col("step"), _bit(f)).otherwise(0) for f in FILTERS), F.lit(0))


def _total(counts: str, which) -> Column:
    """The sum of the counts whose mask satisfies `which`."""
    by_mask = F.transform(F.col(counts), lambda n, m: F.when(which(m), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(by_mask, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step with long counts: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (see masks() for odd rows).  An empty table has no part and gives no row; columns of other names
    are ignored."""
    rows = cells(masks(docs, labels)).withColumn("filter_order", F.explode(orders())).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0])
    rows = rows.withColumn("_bit", F.call_function("shiftleft", F.lit(1), own)).withColumn("_before", _before())
    bit, before = F.col("_bit"), F.col("_before")
    fails, out = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~out(m)
    # a mask's row is removed by each of its filters in the same number of orders
    share = F.transform(F.col("n"), lambda n, m: F.when(fails(m), n * F.lit(factorial(len(FILTERS))) / F.bit_count(m)).otherwise(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        _total("n", lambda m: ~fails(m) & ~out(m)).alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", lambda m: fails(m) & out(m)).alias("redundant"),
        _total("n", lambda m: m == bit).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same in DuckDB, every order joined with every document's conditions counted by part.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (
  SELECT part, fails, len(list_filter(fails, lambda y: y)) AS k, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a, unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT p.a || q.a || r.a || s.a || t.a AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS places
  FROM letters p JOIN letters q ON q.i <> p.i JOIN letters r ON r.i NOT IN (p.i, q.i) JOIN letters s ON s.i NOT IN (p.i, q.i, r.i)
  JOIN letters t ON t.i NOT IN (p.i, q.i, r.i, s.i)
), steps AS (
  SELECT filter_order, step, places[step] AS here, places[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), e AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, n, g, x, k, fails[here] AS hit, len(list_filter(before, lambda b: fails[b])) > 0 AS gone FROM c, steps
)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (hit AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(x) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 / k) FILTER (hit), 0) AS BIGINT) AS shapley
FROM e GROUP BY part, filter_order, step
"""
