"""Data quality: flags, anomalies, scores, duplicates, conflicts, coverage, dictionaries.

Weights are data: a rule table (flag, predicate, weight) gives the flags of a row, its score and, over a table, the
global score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    flag: str
    failed: Column
    weight: float
    problem: str = ""
    suggestion: str = ""


def flags(checks: list[Check]) -> Column:
    return F.array_compact(F.array(*(F.when(c.failed, c.flag) for c in checks)))


def row_score(checks: list[Check]) -> Column:
    """100 less the weights of the failed checks, 0 at least."""
    return F.greatest(F.lit(0.0), 100.0 - sum((F.when(c.failed, c.weight).otherwise(0.0) for c in checks), F.lit(0.0)))


def failed_counts(checks: list[Check]) -> list[Column]:
    return [F.count_if(c.failed).alias(c.flag) for c in checks]


def global_score(df: DataFrame, checks: list[Check], extra: list[tuple[str, float]] = ()) -> DataFrame:
    """One row: entities, each check's count, `score` = max(0, 100 - sum(weight * count) / max(N, 1)).  `extra` names
    columns of df whose sum counts as well."""
    one = df.agg(F.count("*").alias("entities"), *failed_counts(checks), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n, _ in extra))
    weights = [(c.flag, c.weight) for c in checks] + list(extra)
    return one.withColumn("score", penalty_score(F.col("entities"), weights))


def penalty_score(entities: Column, weights: list[tuple[str, float]]) -> Column:
    total = sum((F.col(name) * weight for name, weight in weights), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), 100.0 - total / F.greatest(entities, F.lit(1))), 2)


def anomalies(df: DataFrame, checks: list[Check], keys: list[str]) -> DataFrame:
    """One row for each failed check of each row."""
    found = F.array_compact(F.array(*(F.when(c.failed, F.struct(F.lit(c.flag).alias("flag"), F.lit(c.problem).alias("problem"), F.lit(c.suggestion).alias("suggestion"))) for c in checks)))
    return df.select(*keys, F.explode(found).alias("_a")).select(*keys, "_a.*")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, their number, and how many are too many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").withColumn("excess", F.col("n") - 1)


def parent_conflicts(df: DataFrame, key: str, parents: list[str]) -> DataFrame:
    """Keys seen under more than one value of a parent column."""
    counts = [F.countDistinct(p).alias(f"n_{p}") for p in parents]
    any_more = None
    for p in parents:
        more = F.col(f"n_{p}") > 1
        any_more = more if any_more is None else any_more | more
    return df.groupBy(key).agg(*counts).filter(any_more)


def coverage_band(found: Column, total: Column) -> Column:
    """well covered: at least 50 and at least 75 %; absent: none; weak: below 25 % or fewer than 50; else partial."""
    share = F.try_divide(100.0 * found, total)
    return F.when((found >= 50) & (share >= 75), "bien couverte").when(found == 0, "absente").when((share < 25) | (found < 50), "faible").otherwise("partielle")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def completeness(df: DataFrame, fields: list[str]) -> Column:
    """Share of filled fields among all, over a table (aggregate)."""
    filled = sum((F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")) for f in fields), F.lit(0))
    return F.try_divide(filled, len(fields) * F.count("*"))


def missing_fields(fields: list[str]) -> Column:
    """Names of a row's null fields, in order."""
    return F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in fields)))


def value_kind(text: Column) -> Column:
    """Kind of a written value: bool, int, float, str."""
    return F.when(F.lower(text).isin("true", "false"), "bool").when(text.rlike(r"^[+-]?\d+$"), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("str")


def field_dictionary(df: DataFrame, order: str, fields: list[str] | None = None, examples: int = 10) -> DataFrame:
    """One row a field: values, distinct values, nulls and blanks, first value by `order`, first distinct values, kind.

    Rows are unpivoted in one pass; distinct examples come from each value's first place, so no list grows with the
    table.
    """
    fields = fields or [c for c in df.columns if c != order]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields))
    long = df.select(F.col(order).alias("_ord"), F.explode(pairs).alias("_x")).select("_ord", "_x.field", F.nullif("_x.value", F.lit("")).alias("value"))
    per_value = long.groupBy("field", "value").agg(F.count("*").alias("_n"), F.min("_ord").alias("_first"))
    kinds = ("bool", "int", "float", "str")
    out = per_value.groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("value_count"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("_first", "value"))).alias("example"),
        *(F.count_if(value_kind(F.col("value")) == k).alias(f"_{k}") for k in kinds),
    )
    out = out.join(first_of_each(per_value, "field", examples).withColumnRenamed("field", "_field"), F.col("field") == F.col("_field"), "left").drop("_field")
    known = F.col("unique_count")
    kind = F.when(known == 0, "inconnu").when(F.col("_bool") == known, "bool").when(F.col("_int") == known, "int").when(F.col("_int") + F.col("_float") == known, "float").otherwise("str")
    return out.withColumn("kind", kind).drop(*(f"_{k}" for k in kinds))


def first_of_each(per_value: DataFrame, key: str, n: int) -> DataFrame:
    """From (key, value, _first) the first n non-null values of each key, in order, as the array `examples`.  No task
    holds more than n values of a key: what comes after is left out before the shuffle."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy("_first", "value"))
    first = per_value.filter("value IS NOT NULL").withColumn("_turn", turn).filter(F.col("_turn") <= n)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_turn", "value"))), lambda x: x["value"]).alias("examples"))


def first_values(df: DataFrame, order: str, field: str, n: int) -> DataFrame:
    """The first n distinct non-blank values of a field, in order of first occurrence."""
    seen = df.filter(F.trim(F.col(field).cast("string")) != "").groupBy(F.trim(F.col(field).cast("string")).alias("value")).agg(F.min(order).alias("first"))
    return seen.orderBy("first", "value").limit(n)


#: Expected numbers of entities (fixed values).
EXPECTED_COUNTS = {"province": 26, "ville": 33, "territoire": 145, "chefferie": 259, "secteur": 478, "commune_urbaine": 137, "commune_rurale": 202, "groupement": 6053, "groupement_incorpore": 87, "quartier": 2187, "village": 78855}

#: Weights by level: of a row's checks, and of the global score (fixed values).
ROW_WEIGHTS = {
    "province": {"geometry": 35, "code": 15, "capital": 10},
    "ville": {"province": 30, "zone": 30, "geometry": 40},
    "collectivite": {"territory": 25, "province": 25, "zone": 25, "geometry": 20, "type": 15},
    "groupement": {"parent": 25, "territory": 20, "province": 20, "zone": 20, "geometry": 15, "code": 10},
    "localite": {"orphan": 25, "zone": 20, "geometry": 15, "type": 8},
}
GLOBAL_WEIGHTS = {
    "province": {"geometry": 3, "capital": 1, "code": 1, "duplicates": 4},
    "ville": {"orphan": 25, "geometry": 20, "multi_province": 25, "multi_zone": 25, "duplicates": 20},
    "collectivite": {"territory": 25, "province": 25, "zone": 25, "geometry": 20, "type": 15, "duplicates": 20},
    "groupement": {"parent": 25, "territory": 20, "province": 20, "zone": 20, "geometry": 15, "code": 10, "duplicates": 15, "inconsistency": 5},
    "localite": {"orphan": 25, "unattachable": 20, "geometry": 15, "coordinates": 15, "type": 8, "duplicates": 10},
}
