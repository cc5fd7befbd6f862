"""Order-dependent patterns of tabular sources over an explicit row number: window functions, and for groups too large for
one task the same in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.scratch import ranged


#: A group of more rows than this is dealt out in stretches instead of meeting in one task.
HOT = 1 << 20


def has_hot(df: DataFrame, group: list[str], hot: int) -> bool:
    """Whether a group has more than `hot` rows: counts are summed in each task before they meet."""
    return hot <= 0 or not df.groupBy(*group).count().filter(F.col("count") > hot).isEmpty()


def _two_level(df: DataFrame, group: list[str], order: list[str], summaries: dict[str, Column], before: dict, within: dict) -> DataFrame:
    """A scan of ordered groups in two levels: rows fall into stretches of (group, order) of about equal size, each
    stretch is summed up in one row, and what the stretches before add up to is joined to the rows.

    summaries: aggregates of a stretch; before: from a window over the stretches of a group to columns; within: from a
    window over the rows of a stretch to the columns that are added (they may use those of `before`)."""
    rows = ranged(df, [*group, *order])
    named = {k: f"_g{i}" for i, k in enumerate(group)}
    stretches = rows.groupBy(*(F.col(k).alias(v) for k, v in named.items()), F.col("_stretch").alias("_s")).agg(*(c.alias(n) for n, c in summaries.items()))
    # a group has at most one row a stretch here
    over = Window.partitionBy(*named.values()).orderBy("_s")
    stretches = stretches.select(*named.values(), "_s", *(make(over).alias(n) for n, make in before.items()))
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    rows = rows.join(stretches, [*same, F.col("_stretch") == F.col("_s")])
    inside = Window.partitionBy(*group, "_stretch").orderBy(*order)
    return rows.select(*df.columns, *(make(inside).alias(n) for n, make in within.items()))


def carry_forward(df: DataFrame, value: Column, out: str, group: list[str], order: list[str], hot: int = HOT) -> DataFrame:
    """The last non-null value so far within the group (null keys are a group).  Rows that agree in `order` may come in
    any order."""
    if not has_hot(df, group, hot):
        over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(over))
    scanned = _two_level(
        df.withColumn("_value", value), group, order,
        {"_last": F.max_by(F.struct(F.col("_value").alias("v")), F.when(F.col("_value").isNotNull(), F.struct(*order)))},
        {"_carried": lambda w: F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["v"]},
        {out: lambda w: F.coalesce(F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_carried"))},
    )
    return scanned.drop("_value")


def first_seen(df: DataFrame, keys: list[str], order: list[str], out: str = "occurrence", first: str = "first_row", row: str | None = None, hot: int = HOT) -> DataFrame:
    """Occurrence number within equal keys, and the row that came first."""
    row = row or order[0]
    if not has_hot(df, keys, hot):
        over = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(over)).withColumn(first, F.first(row).over(over))
    return _two_level(
        df, keys, order,
        {"_n": F.count("*"), "_first": F.min_by(F.struct(F.col(row).alias("v")), F.struct(*order))},
        {"_before": lambda w: F.sum("_n").over(w) - F.col("_n"), "_head": lambda w: F.first("_first").over(w)["v"]},
        {out: lambda w: (F.col("_before") + F.row_number().over(w)).cast("int"), first: lambda w: F.col("_head")},
    )


def sums_after(df: DataFrame, group: list[str], order: str, sums: dict[str, Column], hot: int | None = HOT) -> DataFrame:
    """df with sums over the rows of the group (null keys are a group) whose `order` is greater than a row's own.
    hot: None if the caller knows that no group is."""

    def after(c: Column, w) -> Column:
        return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum(c).over(w)

    if hot is None or not has_hot(df, group, hot):
        over = Window.partitionBy(*group).orderBy(order)
        return df.withColumns({out: after(c, over) for out, c in sums.items()})
    named = {out: f"_a{i}" for i, out in enumerate(sums)}
    return _two_level(
        df, group, [order],
        {a: F.sum(sums[out]) for out, a in named.items()},
        {f"{a}r": lambda w, a=a: after(F.col(a), w) for a in named.values()},
        {out: lambda w, a=a, out=out: F.col(f"{a}r") + after(sums[out], w) for out, a in named.items()},
    )


def repeated(df: DataFrame, keys: list[str], out: str = "n_same") -> DataFrame:
    """Number of rows with the same keys, on every one of them: counts joined to the rows, a join that adaptive execution
    splits where a key is hot."""
    named = {k: f"_r{i}" for i, k in enumerate(keys)}
    counts = df.groupBy(*(F.col(k).alias(v) for k, v in named.items())).agg(F.count("*").alias(out))
    return df.join(counts, [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]).drop(*named.values())


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that with the greatest order (a dictionary filled row by row keeps the last)."""
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def numbered_within(df: DataFrame, keys: list[str], order: list[str], out: str, hot: int = HOT) -> DataFrame:
    """Place 1, 2, ... of every row among those of equal keys, null keys being equal too and null orders first.

    Hot groups are cut into stretches of about equal numbers of rows, whatever their values; rows are numbered within a
    stretch, and the sizes of the stretches before are added.
    """
    if not has_hot(df, keys, hot):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return _two_level(
        df, keys, order,
        {"_n": F.count("*")},
        {"_before": lambda w: F.sum("_n").over(w) - F.col("_n")},
        {out: lambda w: F.col("_before") + F.row_number().over(w)},
    )


def numbered_codes(df: DataFrame, prefix: Column, order: list[str], existing: DataFrame | None = None, out: str = "code", width: int = 3) -> DataFrame:
    """Codes prefix_NNN that continue each prefix's greatest number in existing (code).  See
    numbered_within for hot prefixes."""
    from terralith.functions.text import zero_fill

    rows = numbered_within(df.withColumn("_prefix", prefix), ["_prefix"], order, "_n")
    if existing is not None:
        suffix = F.substring_index("code", "_", -1)
        used = existing.select(F.expr("substring(code, 1, length(code) - length(substring_index(code, '_', -1)) - 1)").alias("_used"), suffix.try_cast("int").alias("_top"))
        used = used.groupBy("_used").agg(F.max("_top").alias("_top"))
        rows = rows.join(used, F.col("_prefix") == F.col("_used"), "left").withColumn("_n", F.col("_n") + F.coalesce("_top", F.lit(0)))
    return rows.withColumn(out, F.concat_ws("_", "_prefix", zero_fill(F.col("_n"), width))).select(*df.columns, out)
