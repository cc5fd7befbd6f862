"""Connected components of an edge table by repeated joins: least labels travel along edges, labels of labels jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.  Every step is a
    table; the number of steps grows with the logarithm of the longest path."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter(F.col("a") != F.col("b")).distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_heard"))
        moved = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("_old"), F.least("label", "_heard").alias("_new"))
        moved = materialize(moved)
        jump = moved.select(F.col("node").alias("_n"), F.col("_new").alias("_far"))
        moved = materialize(moved.join(jump, F.col("_new") == F.col("_n")).select("node", "_old", F.least("_new", "_far").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter(F.col("label") != F.col("_old")).isEmpty():
            return labels


def relabel(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with `column` replaced by its label where it has one."""
    known = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    out = rows.join(known, F.col(column) == F.col("_node"), "left")
    return out.select(*(F.coalesce("_label", column).alias(column) if c == column else F.col(c) for c in rows.columns))
