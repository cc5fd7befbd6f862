"""Attaching entities by names under their parents' path: trees by composite keys, and ids level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.functions.text import blank_to_null, display_key, hierarchy_key


@dataclass(frozen=True)
class Level:
    """Nodes of one level: rows (id, nom, and the names `path` of the levels above, the top first).  A node's key is its
    path and its name."""

    name: str
    rows: DataFrame
    path: tuple[str, ...] = ()


def kept_nodes(levels: list[Level]) -> DataFrame:
    """(level, depth, key, id, parent_key) of the nodes that hang in the tree: a top, or one whose parent hangs in it.
    Of nodes with one key the last by (nom, id) stands, as where later entries of a dictionary replace earlier ones."""
    out, above = None, None
    for depth, level in enumerate(levels):
        rows = level.rows.select("id", "nom", hierarchy_key(*level.path, "nom").alias("key"), hierarchy_key(*level.path).alias("parent_key"))
        if above is not None:
            rows = rows.join(above, F.col("parent_key") == F.col("_above"), "left_semi")
        rows = rows.groupBy("key", "parent_key").agg(F.max_by("id", F.struct("nom", "id")).alias("id"))
        part = rows.select(F.lit(level.name).alias("level"), F.lit(depth).alias("depth"), "key", "id", "parent_key")
        above = part.select(F.col("key").alias("_above"))
        out = part if out is None else out.unionByName(part)
    return out


def attached(leaves: DataFrame, nodes: DataFrame, places: dict[str, tuple[str, ...]]) -> DataFrame:
    """leaves with parent_level, parent_id and parent_key of the deepest node that they name, null if none hangs there.

    places: for each level, deepest first, the columns of a leaf that name a node of it; its last column must not be
    blank for the level to be tried.  Each level is a left join with one row a key, so no leaf is doubled; a parent of a
    third of all leaves is one row on its side of a join that adaptive execution splits.
    """
    out = leaves
    for rank, (level, columns) in enumerate(places.items()):
        mine = nodes.filter(F.col("level") == level).select(F.col("key").alias(f"_n{rank}"), F.struct("level", "id", "key").alias(f"_f{rank}"))
        key = F.when(blank_to_null(columns[-1]).isNotNull(), hierarchy_key(*columns))
        out = out.join(mine, key == F.col(f"_n{rank}"), "left")
    found = out.withColumn("_found", F.coalesce(*(F.col(f"_f{rank}") for rank in range(len(places)))))
    return found.select(*leaves.columns, F.col("_found.level").alias("parent_level"), F.col("_found.id").alias("parent_id"), F.col("_found.key").alias("parent_key"))


def child_counts(rows: DataFrame, depth: int) -> DataFrame:
    """(key, n): how many attached rows (parent_key) lie under every node of the first `depth` names of their parent's
    path, so that a territory counts what hangs on its collectivities too."""
    names = F.split("parent_key", r"\|")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(depth))), lambda k: F.array_join(F.slice(names, F.lit(1), k), "|"))
    return rows.filter("parent_key IS NOT NULL").select(F.explode(above).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def unattached(rows: DataFrame, places: dict[str, tuple[str, ...]]) -> DataFrame:
    """What attached() left out, with the reason: that no parent is named, or the key of the deepest one that is."""
    named = F.coalesce(*(F.when(blank_to_null(columns[-1]).isNotNull(), F.concat(F.lit(f"{level} introuvable: "), hierarchy_key(*columns))) for level, columns in places.items()), F.lit("aucun parent nommé"))
    return rows.filter("parent_level IS NULL").withColumn("reason", named).drop("parent_level", "parent_id", "parent_key")


def ids_under_parents(levels: list[Level], key=display_key) -> dict[str, DataFrame]:
    """For each level its rows with parent_id: the id of the node whose name the row's path gives, below the id of the
    node above it, and so on from the top.  The id found at one level is part of the key of the next, so equal names under
    two parents stay apart.  Rows of the top have none; a name that isn't found leaves parent_id null.  Of nodes with
    one name under one parent the last by (nom, id) stands.
    """
    out: dict[str, DataFrame] = {}
    known: list[DataFrame] = []  # of each level: _parent, _name, _found
    for level in levels:
        rows = level.rows.withColumn("_at", F.lit(None).cast(dict(level.rows.dtypes)["id"]))
        for depth, column in enumerate(level.path):
            # at the top only the name counts; below, rows that found nothing above find nothing here
            same = key(column) == F.col("_name")
            if depth:
                same = same & (F.col("_at") == F.col("_parent"))
            rows = rows.join(known[depth], same, "left").withColumn("_at", F.col("_found")).drop("_parent", "_name", "_found")
        rows = rows.withColumnRenamed("_at", "parent_id")
        out[level.name] = rows
        hanging = rows if not level.path else rows.filter("parent_id IS NOT NULL")
        known.append(hanging.groupBy(F.col("parent_id").alias("_parent"), key("nom").alias("_name")).agg(F.max_by("id", F.struct("nom", "id")).alias("_found")))
    return out
