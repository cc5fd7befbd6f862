"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Every document draws the exponential key -ln(u) / weight; the documents of a source in ascending key order are a
weighted random order.  A source's target is met with complete epochs first; what remains is the prefix of that
order whose sizes fill the remaining budget.  The prefix is found without sorting a source in one task: documents fall
into RANGES ranges of their source's key quantiles, of about equal numbers whatever the weights; range totals are
prefix-summed, and only the range in which the budget ends is sorted.

DataFrame operations only.  The sole windows run over sources, over key ranges of a source, and over the documents
of one key range of each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import clear_of, materialize, quoted, table, text_key, text_or_empty

#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
#: Ranges of keys of a source.
RANGES = 128


def word_count(col: str = "text") -> F.Column:
    """Number of runs of characters other than space, tab, LF, VT, FF, CR; null text has none."""
    return F.regexp_count(text_or_empty(col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sources (source, source_size, n_docs) with `target` added: total_share of all sizes dealt by weight, no
    source above max_epochs times its size, the excess reshared by weight until none is above.

    The fixed point of resharing is a water level: target = min(weight * level, cap).  Sources ordered by
    cap / weight are full up to some rank; the level follows from running sums.  Sources of size 0 get target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("_w", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    order = [F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (total_share * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    # from the first rank whose share stays below its cap on, levels only fall: the largest such level is the one
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
    ranked = ranked.withColumn("_set", F.max(F.when(F.col("_free"), F.col("_level"))).over(whole))
    return ranked.withColumn("target", F.coalesce(F.least(F.col("_w") * F.col("_set"), F.col("_cap")), F.col("_cap"))).drop("_w", "_cap", "_level", "_free", "_set")


def _in_ranges(light: DataFrame, plan: DataFrame) -> DataFrame:
    """light with its source's plan and _range, the number of the source's bounds below the key: rows that tie share one.
    The plan is written, so its bounds are the same for all who ask."""
    joined = light.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_key")))).drop("_bounds")


def mix(docs: DataFrame, seed: str = "mix-1", total_share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, quality: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, epochs,
    selected, taken, and the columns `keep`.

    taken = size * (epochs + selected): words that the mix takes of this row.  A row with size 0 is never selected.
    Null text has size 0; null source is a source of its own; null doc_id is allowed; repeated rows are rows of
    their own that tie in key order.  An empty table gives an empty result.  quality (doc_id, weight), one
    row a document, gives document weights; weights that are absent, null, not finite or not positive count as 1.
    Other columns are ignored.
    """
    draw = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty()), 256)
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    light = docs.select("doc_id", "source", word_count().alias("size"), (-F.log(u)).alias("_key"), *keep)
    if quality is not None:
        known = quality.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("weight").cast("double").alias("_w"))
        weight = F.when((F.col("_w") > 0) & (F.col("_w") < float("inf")), F.col("_w")).otherwise(1.0)
        light = light.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("_key", F.col("_key") / weight).drop("_id", "_w")
    light = materialize(light)

    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.percentile_approx("_key", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("_bounds"))
    plan = source_targets(sources, total_share, max_epochs, weights).withColumn("target", F.col("target").cast("double"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_left", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan.withColumnRenamed("source", "_source"), 1)

    placed = _in_ranges(light, plan)
    ranges = placed.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"), F.first("_left").alias("_left"))
    running = Window.partitionBy("_source").orderBy("_range")
    ranges = ranges.withColumn("_end", F.sum("_sum").over(running)).withColumn("_start", F.col("_end") - F.col("_sum"))
    cut = ranges.filter((F.col("_start") < F.col("_left")) & (F.col("_left") <= F.col("_end")))
    # one row a source: the range in which its budget ends
    cut = cut.groupBy("_source").agg(F.min_by("_range", "_range").alias("_cut"), F.min_by("_start", "_range").alias("_start"))
    cut = materialize(plan.join(cut.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), 1)

    placed = _in_ranges(light, cut)
    within = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = F.col("_range") == F.col("_cut")
    outside = placed.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("selected", F.coalesce(F.col("_range") < F.col("_cut"), F.lit(False)))
    inside = placed.filter(at_cut).withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    inside = inside.withColumn("selected", F.col("_before") + F.col("size") / 2 <= F.col("_left")).drop("_before")
    both = outside.unionByName(inside).withColumn("selected", (F.col("selected") & (F.col("size") > 0)).cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", "epochs", "selected", (F.col("size") * (F.col("epochs") + F.col("selected"))).alias("taken"), *keep)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (rows that it doesn't take go).  Rows that agree in
    id, text and source are one row here, repeated as often as all of them are taken."""
    own = {c: clear_of(c, docs.columns) for c in ("text_key", "id", "key", "source", "times", "copy")}
    keyed = docs.withColumn(own["text_key"], text_key())
    rows = keyed.select("doc_id", "text", "source", F.col(own["text_key"]).alias("_text_key"))
    taken = mix(rows, keep=("_text_key",), **how).groupBy("doc_id", "_text_key", "source").agg(F.sum(F.col("epochs") + F.col("selected")).alias("_times")).filter("_times > 0")
    taken = taken.select(F.col("doc_id").alias(own["id"]), F.col("_text_key").alias(own["key"]), F.col("source").alias(own["source"]), F.col("_times").alias(own["times"]))
    single = keyed.dropDuplicates(["doc_id", own["text_key"], "source"])
    same = F.col("doc_id").eqNullSafe(F.col(own["id"])) & (F.col(own["text_key"]) == F.col(own["key"])) & F.col("source").eqNullSafe(F.col(own["source"]))
    copies = single.join(taken, same).withColumn(own["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(own["times"]))))
    return copies.select(*map(quoted, docs.columns))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 where a document is labelled good, 0.5 where labelled bad."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("_q"))
    return best.select("doc_id", F.when(F.col("_q") >= 1, 2.0).when(F.col("_q") < 1, 0.5).alias("weight"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), quality=label_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "selected")


#: The same by DuckDB, a source sorted at once.
OP6_SQL = r"""
WITH light AS (
  SELECT d.doc_id, d.source,
         CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(sha256('mix-1' || chr(31) || coalesce(CAST(d.doc_id AS VARCHAR), '') || chr(31) || coalesce(d.text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / coalesce(q.weight, 1.0) AS k
  FROM documents d LEFT JOIN (
    SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 2.0 WHEN max(quality) < 1 THEN 0.5 END AS weight FROM labels GROUP BY doc_id
  ) q ON d.doc_id = q.doc_id
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM light GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, coalesce(least(w * max(CASE WHEN level * w < cap THEN level END) OVER (), cap), cap) AS target FROM l
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT light.doc_id, light.source, light.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         coalesce(sum(light.size) OVER (PARTITION BY light.source ORDER BY light.k, light.doc_id, light.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM light JOIN p ON light.source IS NOT DISTINCT FROM p.source
), f AS (
  SELECT *, CASE WHEN size > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END AS selected FROM r
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (epochs + selected) AS BIGINT) AS taken,
       source, CAST(epochs AS BIGINT) AS epochs, CAST(selected AS BIGINT) AS selected
FROM f
"""
