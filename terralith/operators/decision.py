"""Ranked decision queries, search, pages and lookups over a hierarchy with profile tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.scratch import ranged


def ilike_any(columns: list[str], text: str | None) -> Column | None:
    """Whether any column contains the text, in any case; its own % and _ are wild, as in ILIKE."""
    return None if text is None else reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{text}%") for c in columns))


def is_true(c: str) -> Column:
    return F.col(c).eqNullSafe(F.lit(True))


def is_false(c: str) -> Column:
    return F.col(c).eqNullSafe(F.lit(False))


#: Columns that a network generation stands for (fixed values).
COVERAGE = {"2G": "couverture_2g", "3G": "couverture_3g", "4G": "couverture_4g", "5G": "couverture_5g"}


def coverage_filter(generation: str | None) -> Column | None:
    column = COVERAGE.get((generation or "").upper())
    return None if column is None else is_true(column)


def all_of(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """df filtered by every predicate that is given."""
    for p in predicates:
        df = df if p is None else df.filter(p)
    return df


def ranked(df: DataFrame, score: str, name: str, key: str, limit: int) -> DataFrame:
    """Highest scores first, null scores last, then by name, then by key."""
    return df.orderBy(F.col(score).desc_nulls_last(), name, key).limit(limit)


def page(df: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def recent_first(df: DataFrame, moment: str, key: str, skip: int, limit: int) -> DataFrame:
    """A page near the start, latest rows first, then by key; null moments last.  See Pages for pages far from it."""
    return df.orderBy(F.col(moment).desc_nulls_last(), key).offset(skip).limit(limit)


class Pages:
    """Pages of df in `order`, which should tell all rows apart, for any place in it.

    Made once: rows are written in ranges of the order, one folder a range.  A page then sorts only the ranges that it
    touches, found by the sums of their sizes (one number a range is all that the driver holds); the files of other
    ranges aren't read.  An empty table has no row on any page."""

    def __init__(self, df: DataFrame, order: list) -> None:
        self.order, self.rows = order, ranged(df, order, "_page_range", partitioned=True)
        self.sizes = sorted((r[0], r[1]) for r in self.rows.groupBy("_page_range").count().collect())

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def at(self, skip: int, limit: int) -> DataFrame:
        """`limit` rows after the first `skip`, in order."""
        touched, before, start = [], 0, None
        for number, n in self.sizes:
            if before < skip + limit and before + n > skip:
                touched.append(number)
                start = before if start is None else start
            before += n
        rows = self.rows.filter(F.col("_page_range").isin(touched)).drop("_page_range")
        return rows.orderBy(*self.order).offset(skip - (start or 0) if touched else 0).limit(limit)


def clamped_page(total: int, size: int, asked: int) -> int:
    """The page asked for, within 1 and the last page."""
    return min(max(asked, 1), max(1, -(-total // size)))


def lookup(df: DataFrame, key: str, code: str, value: str) -> DataFrame:
    """The row whose id or code is the value; of several the least id."""
    return df.filter((F.col(key).cast("string") == value) | (F.col(code) == value)).orderBy(key).limit(1)


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))


def any_column_contains(columns: list[str], text: str) -> Column:
    return F.exists(F.array(*(F.lower(F.col(c).cast("string")) for c in columns)), lambda x: x.contains(text.lower()))


def cascade(first: DataFrame, second: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows of first; if there are fewer, second fills the rest.  Both are cut to the limit before
    they meet, so the window that numbers them holds at most twice the limit."""
    ranked_first = first.orderBy(*order).limit(limit).withColumn("source_rank", F.lit(0))
    ranked_second = second.orderBy(*order).limit(limit).withColumn("source_rank", F.lit(1))
    both = ranked_first.unionByName(ranked_second, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.orderBy("source_rank", *order))).filter(F.col("_n") <= limit).drop("_n")


#: Ranks of priorities (fixed values).
PRIORITY_RANK = {"critique": 0, "haute": 1, "normale": 2}


def priority_rank(c: Column) -> Column:
    out = None
    for name, rank in PRIORITY_RANK.items():
        out = F.when(c == name, rank) if out is None else out.when(c == name, rank)
    return out.otherwise(9)


def score_badge(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "bon").when(score >= 50, "moyen").otherwise("faible")
