"""Idempotent imports: every staged row gets an action or a reason to reject it; the new snapshot is a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.text import blank_to_null
from terralith.operators.windows import numbered_within


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """df with one row a key, the least by all its columns, so that no join on the key fans out; rows without a key all
    stay."""
    rest = [c for c in df.columns if c != key]
    single = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_least")) if rest else df.filter(F.col(key).isNotNull()).distinct()
    single = single.select(*(F.col(key) if c == key else F.col(f"_least.{c}").alias(c) for c in df.columns)) if rest else single
    return single.unionByName(df.filter(F.col(key).isNull()))


def planned_actions(staged: DataFrame, existing: DataFrame, key: str, compared: list[str], parents: DataFrame | None = None, parent: str | None = None, required: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """staged (order, key, ...) with `action` (insert, update, unchanged, reject) and `reason`.

    Rejected are rows with a blank required column, rows that repeat an earlier row's key, and rows whose parent is
    unknown, in this order.  `order` is distinct from row to row.  A key that `existing` repeats counts once (see
    one_row_each).  Nothing is written.
    """
    rows = staged.withColumn("_key", blank_to_null(F.col(key).cast("string")))
    # an aggregate and a join instead of a window: a code that many rows repeat is combined before the shuffle
    firsts = rows.filter("_key IS NOT NULL").groupBy(F.col("_key").alias("_k")).agg(F.min(order).alias("_first"))
    rows = rows.join(firsts, F.col("_key") == F.col("_k"), "left")
    reason = F.when(F.col("_key").isNull(), F.lit(f"{key} manquant"))
    for c in required:
        reason = reason.when(blank_to_null(F.col(c).cast("string")).isNull(), F.lit(f"{c} manquant"))
    reason = reason.when(F.col(order) > F.col("_first"), F.lit("Doublon dans le fichier"))
    if parents is not None:
        known = parents.select(F.col(parents.columns[0]).cast("string").alias("_parent")).distinct()
        rows = rows.join(known, blank_to_null(F.col(parent).cast("string")) == F.col("_parent"), "left")
        reason = reason.when(F.col("_parent").isNull(), F.lit("Parent inconnu"))
    before = existing.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_old_key")).agg(F.min(F.struct(*compared)).alias("_old"))
    rows = rows.join(before, F.col("_key") == F.col("_old_key"), "left")
    changed = ~F.struct(*compared).eqNullSafe(F.col("_old"))
    action = F.when(reason.isNotNull(), "reject").when(F.col("_old_key").isNull(), "insert").when(changed, "update").otherwise("unchanged")
    return rows.select(*staged.columns, action.alias("action"), reason.alias("reason"))


def preview(planned: DataFrame) -> DataFrame:
    """Number of rows for each action and reason."""
    return planned.groupBy("action", "reason").agg(F.count("*").alias("n"))


def first_errors(planned: DataFrame, order: str = "ord", n: int = 50) -> DataFrame:
    """The first n rejected rows, in order: what a preview lists."""
    return planned.filter("action = 'reject'").select(order, "reason").orderBy(order).limit(n)


def set_null(rows: DataFrame, parent: str, gone: DataFrame) -> DataFrame:
    """rows whose optional reference `parent` is among the deleted (gone: column key) lose the reference and stay."""
    dropped = gone.select(F.col("key").alias("_gone")).distinct()
    joined = rows.join(dropped, F.col(parent) == F.col("_gone"), "left")
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == parent else F.col(c) for c in rows.columns))


def strict(planned: DataFrame) -> DataFrame:
    """The plan, or an error if any row is rejected."""
    first = planned.filter("action = 'reject'").limit(1).collect()
    if first:
        raise ValueError(f"rejected: {first[0]['reason']}")
    return planned


def apply_changes(existing: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """The snapshot after the planned inserts and updates, one row a key: a full join on the key, new values first."""
    written = planned.filter(F.col("action").isin("insert", "update")).select(*existing.columns)
    new = one_row_each(written, key).select(F.col(key).alias("_k"), F.struct(*existing.columns).alias("_new"))
    old = one_row_each(existing, key).select(F.col(key).alias("_o"), F.struct(*existing.columns).alias("_old"))
    both = old.join(new, F.col("_o") == F.col("_k"), "full_outer")
    return both.select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def skip_existing(existing: DataFrame, staged: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, the first by `order` of each new key, and rows to leave out: those of known keys, later ones of
    new keys, and those without a key."""
    first = staged.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    rows = staged.join(first, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_first")), "left")
    known = existing.select(F.col(key).alias("_known")).distinct()
    rows = rows.join(known, F.col(key) == F.col("_known"), "left")
    new = F.col("_first").isNotNull() & F.col("_known").isNull()
    return rows.filter(new).select(*staged.columns), rows.filter(~new).select(*staged.columns)


def reseeded(existing: DataFrame, fresh: DataFrame, source: str, name: str) -> DataFrame:
    """The snapshot with all rows of source `name` (column `source`) replaced by `fresh`."""
    return existing.filter(~F.col(source).eqNullSafe(F.lit(name))).unionByName(fresh)


def zipped(rows: DataFrame, profiles: DataFrame, order: str, turn: str) -> DataFrame:
    """rows with the profile whose `turn` (0, 1, ...) is the row's place by `order`, going round the profiles.  Places of
    many rows come from ranges of the order (see windows.numbered_within)."""
    n = profiles.count()
    numbered = numbered_within(rows.withColumn("_all", F.lit(0)), ["_all"], [order], "_n")
    placed = numbered.withColumn("_place", F.pmod(F.col("_n") - 1, F.lit(max(n, 1)))).drop("_all", "_n")
    return placed.join(profiles.withColumnRenamed(turn, "_turn"), F.col("_place") == F.col("_turn"), "left").drop("_place", "_turn")


def ordered_import(levels: list[tuple[str, DataFrame, DataFrame, str | None]], key: str, compared: list[str], required: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Plans of several levels, top down: (level, staged, existing, parent column).  A level's rows may hang on rows
    that the level above has or is about to get."""
    plans, above = {}, None
    for level, staged, existing, parent in levels:
        plans[level] = planned_actions(staged, existing, key, compared, above if parent else None, parent, required)
        above = existing.select(key).unionByName(plans[level].filter("action IN ('insert', 'update', 'unchanged')").select(key))
    return plans


def import_totals(plans: dict[str, DataFrame], most_rejected: float = 0.5) -> DataFrame:
    """One row an import: rows, rejected, accepted, and whether more than `most_rejected` of its rows are rejected."""
    out = None
    for level, plan in plans.items():
        one = plan.agg(F.lit(level).alias("import"), F.count("*").alias("rows"), F.count_if(F.col("action") == "reject").alias("rejected"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("accepted", F.col("rows") - F.col("rejected")).withColumn("failed", F.col("rejected") > most_rejected * F.col("rows"))


def missing_parents(staged: DataFrame, parents: DataFrame, parent: str, key: str, prefix: str = "AUTO_") -> DataFrame:
    """Parents that staged rows name and the parents lack: (key, name, automatic code)."""
    named = staged.select(blank_to_null(F.col(parent)).alias("name")).dropna().distinct()
    gone = named.join(parents.select(F.col(key).alias("name")), "name", "left_anti")
    return gone.select("name", F.concat(F.lit(prefix), F.upper(F.substring(F.md5("name"), 1, 8))).alias("code"))


def same_name_other_code(staged: DataFrame, existing: DataFrame, name: str, code: str) -> DataFrame:
    known = existing.select(F.col(name).alias("_name"), F.col(code).alias("existing_code"))
    return staged.join(known, (F.col(name) == F.col("_name")) & (F.col(code) != F.col("existing_code"))).drop("_name")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compared: list[str], geometry: str | None = None) -> DataFrame:
    """(key, change, fields): added, removed, geometry, attributes or modified (both), with the changed columns."""
    old = before.select(F.col(key).alias("_a"), F.struct(*compared).alias("_old"))
    new = after.select(F.col(key).alias("_b"), F.struct(*compared).alias("_new"))
    both = old.join(new, F.col("_a") == F.col("_b"), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), c) for c in compared)))
    plain = F.size(F.filter("fields", lambda c: c != F.lit(geometry or "")))
    shape = F.size("fields") - plain
    rows = both.withColumn("fields", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when((shape > 0) & (plain > 0), "modified").when(shape > 0, "geometry").when(plain > 0, "attributes")
    return rows.select(F.coalesce("_a", "_b").alias(key), kind.alias("change"), "fields").filter("change IS NOT NULL")


#: Review states and what they may become (fixed values).
PROPOSED, VALIDATED, REJECTED = "propose", "valide", "rejete"


def transitions(suggestions: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """suggestions (id, status, validated_at, validated_by, ...) after decisions (id, decision, by): only proposed ones
    change; accepting stamps who and when, rejecting clears the stamp."""
    # of several decisions on one suggestion the least by (decision, by) counts: accept before reject
    asked = decisions.groupBy(F.col("id").alias("_id")).agg(F.min(F.struct("decision", "by")).alias("_d")).select("_id", "_d.decision", "_d.by")
    rows = suggestions.join(asked, F.col("id") == F.col("_id"), "left")
    moved = (F.col("status") == PROPOSED) & F.col("decision").isin("accept", "reject")
    accept = moved & (F.col("decision") == "accept")
    return rows.select(
        *(c for c in suggestions.columns if c not in ("status", "validated_at", "validated_by")),
        F.when(accept, VALIDATED).when(moved, REJECTED).otherwise(F.col("status")).alias("status"),
        F.when(accept, as_of).when(moved, F.lit(None)).otherwise(F.col("validated_at")).alias("validated_at"),
        F.when(accept, F.col("by")).when(moved, F.col("by")).otherwise(F.col("validated_by")).alias("validated_by"),
    )
