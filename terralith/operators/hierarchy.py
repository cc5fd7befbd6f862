"""Operators over levels of a hierarchy kept as one table a level or one (node, parent) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralith.operators.windows import numbered_within


def chain(base: DataFrame, parents: Sequence[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """base joined to its parents one after another: (table, child key, parent key).  Which side is broadcast is left
    to the optimiser, which knows the sizes."""
    for table, child, parent in parents:
        base = base.join(table, F.col(child) == F.col(parent), how)
    return base


def members_index(df: DataFrame, keys: list[str], member: Column, count: str = "n", members: str = "members", separator: str = ", ") -> DataFrame:
    """Per key the sorted members, joined, and their number: a report for groups that fit into one text (see
    member_rows)."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(member)), separator).alias(members), F.count("*").alias(count))


def member_rows(df: DataFrame, keys: list[str], member: Column, out: str = "member") -> DataFrame:
    """The members of every key as rows in order: what to write for groups of any size.  The sort is by ranges of (key,
    member), so that a hot key is spread over tasks."""
    return df.select(*keys, member.alias(out)).orderBy(*keys, out)


def prefix_counts(df: DataFrame, levels: list[str], count: str = "n") -> DataFrame:
    """Counts at every prefix of the levels, in one pass (grouping sets); depth is the number of levels given."""
    depth = sum(((1 - F.grouping(c)).cast("int") for c in levels), F.lit(0))
    return df.rollup(*levels).agg(F.count("*").alias(count), depth.alias("depth"))


def tree_rows(df: DataFrame, levels: list[str], separator: str = " > ") -> DataFrame:
    """One row a node: depth, label, path label, parent path and number of rows below; pre-order is by path."""
    counts = prefix_counts(df, levels).filter("depth > 0")
    names = [F.col(c).cast("string") for c in levels]
    path = F.slice(F.array(*names), 1, F.col("depth"))
    return counts.withColumn("path", path).select(
        "depth",
        F.element_at("path", -1).alias("label"),
        F.array_join("path", separator).alias("path_label"),
        F.when(F.col("depth") > 1, F.array_join(F.slice("path", 1, F.col("depth") - 1), separator)).alias("parent_path"),
        "n",
        "path",
    )


def preorder(tree: DataFrame, **how) -> DataFrame:
    """Position of every node within its first-level branch, in pre-order (binary order of names); a hot branch is
    numbered by stretches of its paths (see windows.numbered_within, which takes `how`)."""
    rows = numbered_within(tree.withColumn("_top", F.element_at("path", 1)), ["_top"], ["path"], "position", **how)
    return rows.withColumn("position", F.col("position").cast("int")).select(*tree.columns, "position")


def visible_nodes(tree: DataFrame, matches: Column) -> DataFrame:
    """Nodes that match or have a matching descendant: matching paths, all their prefixes, met by a semi join."""
    hit = tree.filter(matches)
    prefixes = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("_path")).distinct()
    return tree.join(prefixes, F.col("path") == F.col("_path"), "left_semi")


def without_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(child_key), F.col(parent_key) == F.col(child_key), "left_anti")


def cascade_delete(levels: list[tuple[str, DataFrame, str, str | None]], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables (name, rows, key, parent key) from the top down, without the rows `gone` (key column `key`) of the top
    and everything below them."""
    out, dropped = {}, gone.select("key")
    for name, rows, key, parent in levels:
        own = key if parent is None else parent
        out[name] = rows.join(dropped, F.col(own) == F.col("key"), "left_anti")
        dropped = rows.join(dropped, F.col(own) == F.col("key"), "left_semi").select(F.col(key).alias("key"))
    return out


#: Which levels a level's parent may have (fixed values).
ALLOWED_PARENTS = {
    "province": ("zone",),
    "territoire": ("province",),
    "secteur": ("territoire",),
    "chefferie": ("territoire",),
    "groupement": ("secteur", "chefferie"),
    "groupement_incorpore": ("secteur", "chefferie"),
    "village": ("groupement", "groupement_incorpore"),
    "ville": ("province",),
    "commune_urbaine": ("ville",),
    "commune_rurale": ("territoire",),
    "quartier": ("commune_urbaine",),
}


def parent_rules(spark) -> DataFrame:
    return spark.createDataFrame([(c, p) for c, ps in ALLOWED_PARENTS.items() for p in ps], "child_type string, parent_type string")


def resolve_staging_parents(staging: DataFrame) -> DataFrame:
    """staging (ord, id, entity_type, code, parent_code, name_key, province_key, territory_key) with parent_id.

    By parent code (of equal codes the last row), else the first row, in input order, whose type may be the parent's
    and whose name is the province or the territory.  Two equi-joins instead of a search through all rows.  Of rows
    with one name and type only the first two are joined: one of them isn't the row itself.  Ids are distinct.
    """
    spark = staging.sparkSession
    by_code = staging.filter("code IS NOT NULL").groupBy("code").agg(F.max_by("id", "ord").alias("_by_code")).withColumnRenamed("code", "_code")
    named = staging.filter("name_key <> ''").select(F.col("ord").alias("_ord"), F.col("id").alias("_pid"), F.col("entity_type").alias("_ptype"), F.col("name_key").alias("_name"))
    turn = F.row_number().over(Window.partitionBy("_name", "_ptype").orderBy("_ord"))
    named = named.withColumn("_turn", turn).filter("_turn <= 2").drop("_turn")
    rules = parent_rules(spark)
    found = None
    for key in ("province_key", "territory_key"):
        part = staging.filter(F.col(key) != "").join(rules, F.col("entity_type") == F.col("child_type")).join(named, (F.col(key) == F.col("_name")) & (F.col("parent_type") == F.col("_ptype")) & (F.col("id") != F.col("_pid"))).select(F.col("id").alias("_id"), "_ord", "_pid")
        found = part if found is None else found.unionByName(part)
    by_name = found.groupBy("_id").agg(F.min_by("_pid", "_ord").alias("_by_name"))
    out = staging.join(by_code, F.col("parent_code") == F.col("_code"), "left").join(by_name, F.col("id") == F.col("_id"), "left")
    return out.select(*staging.columns, F.coalesce("_by_code", "_by_name").alias("parent_id"))
