"""Entity matching within blocks.

A pair's score is 0.70 for equal codes, 0.25 for equal (or nearly equal: 0.15 similar) names and 0.05 for equal
parents; pairs below 0.60 are no candidates.  Without equal codes a pair reaches 0.30 at most, so joining on
(type, code) finds every candidate.  Candidates of one code are met once, smaller order first.

The similarity of names is a Python ratio.  It is asked for only where it can matter: equal names are told apart by a
comparison, and of two different ones columns give a bound (twice the letters that they share, over all their letters)
that the ratio never exceeds; pairs whose bound lies below the least ratio that counts send no names to Python.
`near_names` asks once for two names of a code, however many entities have them.

`pair_totals` counts the pairs of each kind without making them: what comes after an entity is counted by scans of
ordered groups, so its work grows like that of a sort.
"""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralith.operators.windows import HOT, has_hot, sums_after
from terralith.scratch import written

LEAST, MOST = 0.60, 0.99
#: Entities of one code that meet in a task, on either side.
BLOCK = 4096
#: Pairs of rows that a task compares, about, and the most parts that a join is dealt out to.
MEETINGS, MOST_PARTS = 1 << 21, 1 << 14
NEARLY_EQUAL, SIMILAR = 0.92, 0.82


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two names, worked out once for equal pairs of a batch; 0 where one is null."""
    pairs = list(zip(a, b))
    found = {(x, y): 0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in set(pairs)}
    return pd.Series([found[p] for p in pairs], dtype="float64")


def with_bag(rows: DataFrame, name: str = "name", out: str = "bag") -> DataFrame:
    """rows with the letters of a name, each with its turn among equal ones (aab: a1, a2, b1), so that what two bags have
    in common counts repeated letters as often as both names have them."""
    letters = F.array_sort(F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit("(?s)."), F.lit(0)))
    turn = F.transform("_letters", lambda c, i: F.concat(c, (i - F.array_position(F.col("_letters"), c) + 2).cast("string")))
    return rows.withColumn("_letters", letters).withColumn(out, turn).drop("_letters")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio of two names, from their bags."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def in_blocks(known: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """A table as left and right side of a join with itself on `keys` and (_i, _j): the rows of a key are dealt into blocks
    of about `block`, and each block of the left side meets each of the right side, one pair of blocks a key.  Keys of no
    more than `block` rows have one block, and if all are so, nothing is counted again or repeated.  Where many rows meet,
    both sides are dealt out by what they meet, not by their own size, which is small."""
    counts = known.groupBy(*(F.col(k).alias(f"_b_{k}") for k in keys)).count()
    most, met = counts.agg(F.max("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    if (most or 0) <= block:
        left = right = known.withColumns({"_i": F.lit(0), "_j": F.lit(0)})
    else:
        blocks = counts.select(*(f"_b_{k}" for k in keys), F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
        rows = known.join(blocks, [F.col(k) == F.col(f"_b_{k}") for k in keys]).drop(*(f"_b_{k}" for k in keys))
        rows = rows.withColumn("_own", F.pmod(F.xxhash64(*known.columns), F.col("_blocks")).cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        left, right = (rows.withColumn(own, F.col("_own")).withColumn(other, others).drop("_own", "_blocks").select(*known.columns, "_i", "_j") for own, other in (("_i", "_j"), ("_j", "_i")))
    parts = min(int((met or 0) / MEETINGS), MOST_PARTS)
    if parts < 2:
        return left, right
    return tuple(side.repartition(parts, *keys, "_i", "_j") for side in (left, right))


def kind_pairs(entities: DataFrame, ratio=name_ratio, block: int = BLOCK) -> DataFrame:
    """entities (ord, id, entity_type, code, name, parent) as pairs (left_id, right_id, kind), kind being a place in KINDS,
    in no order.  Null codes meet nothing; the entities of a hot code meet block by block.  A pair compares its names and
    looks for the right one in the list of those near the left one, which is as long as a block at most."""
    # null and blank names are alike
    known = entities.filter("code IS NOT NULL").select("ord", "id", "entity_type", "code", F.coalesce("name", F.lit("")).alias("name"), "parent")
    left, right = in_blocks(known, ["entity_type", "code"], block)
    met = right.select("entity_type", "code", "_j", F.col("name").alias("other")).distinct()
    lists = (F.collect_list(F.when(F.col("level") == level, F.col("other"))).alias(f"near{level}") for level in (1, 2))
    near = near_names(known, ratio, block).join(met, ["entity_type", "code", "other"]).groupBy("entity_type", "code", "_j", "name").agg(*lists)
    left = left.join(near, ["entity_type", "code", "_j", "name"], "left")
    left, right = (rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)) for side, rows in (("l", left), ("r", right)))
    keys = ("entity_type", "code", "_i", "_j")
    pairs = left.join(right, [*(F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys), F.col("l_ord") < F.col("r_ord")])
    listed = {level: F.coalesce(F.array_contains(F.col(f"l_near{level}"), F.col("r_name")), F.lit(False)) for level in (1, 2)}
    level = F.when((F.col("l_name") == F.col("r_name")) | listed[2], 2).when(listed[1], 1).otherwise(0)
    kind = (2 * level + F.when(F.col("l_parent") == F.col("r_parent"), 1).otherwise(0)).cast("int")
    return pairs.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), kind.alias("kind"))


def candidate_pairs(entities: DataFrame, ratio=name_ratio, block: int = BLOCK, joined: bool = False) -> DataFrame:
    """The pairs of entities with confidence and reasons (joined: as one text), in no order (`best_first` sorts them)."""
    return kind_pairs(entities, ratio, block).select("left_id", "right_id", *_told(joined))


def near_names(entities: DataFrame, ratio=name_ratio, block: int = BLOCK) -> DataFrame:
    """(entity_type, code, name, other, level): two different names of a code whose ratio counts, level 2 if they are
    nearly equal and 1 if similar.  The ratio of two names depends on which comes first; one whose entities all come after
    those of the other is never its left."""
    spans = entities.groupBy("entity_type", "code", "name").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    left, right = in_blocks(with_bag(spans), ["entity_type", "code"], block)
    other = right.select("entity_type", "code", "_i", "_j", F.col("name").alias("other"), F.col("last").alias("until"), F.col("bag").alias("other_bag"))
    longest, both = F.greatest(F.size("bag"), F.size("other_bag")), F.size("bag") + F.size("other_bag")
    # the lengths alone bound the ratio, and cost less than the letters
    able = (F.col("name") != F.col("other")) & (F.col("first") < F.col("until")) & (2.0 * (both - longest) >= SIMILAR * both)
    asked = left.join(other, ["entity_type", "code", "_i", "_j"]).filter(able).filter(ratio_bound(F.col("bag"), F.col("other_bag")) >= SIMILAR)
    found = asked.select("entity_type", "code", "name", "other", ratio(F.col("name"), F.col("other")).alias("ratio")).filter(F.col("ratio") >= SIMILAR)
    return found.select("entity_type", "code", "name", "other", F.when(F.col("ratio") >= NEARLY_EQUAL, 2).otherwise(1).alias("level"))


#: By level of the names (other, similar, equal or nearly so) and whether parents are equal: confidence and reasons.  None
#: lies below LEAST, as equal codes alone give 0.70.
KINDS = {
    (level, parent): (min(round(0.70 + name + 0.05 * parent, 2), MOST), ["code identique", *reason, *["meme parent"] * parent])
    for level, (name, reason) in enumerate([(0.0, []), (0.15, ["nom proche"]), (0.25, ["nom identique"])]) for parent in (0, 1)
}


def pair_totals(entities: DataFrame, ratio=name_ratio, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """What candidate_pairs counts up to: (confidence, reasons, n, first_left, spread) with the number of pairs of each
    kind, the least left id and the sum of right less left id, which are numbers.  No pair is made: for each entity
    those that come after it within its code, and of these the ones of its name, parent or both, and of each near name,
    are counted and their ids summed up; the others are what remains."""
    known = entities.filter("code IS NOT NULL AND entity_type IS NOT NULL AND ord IS NOT NULL").withColumn("name", F.coalesce("name", F.lit("")))
    keys = ["entity_type", "code", "name", "parent", "ord", "id"]
    plain = rows = written(known.groupBy(*keys).agg(F.count("*").alias("w")))
    weight, ids = F.col("w"), F.col("w") * F.col("id").cast("long")
    some = hot if has_hot(rows, ["entity_type", "code"], hot) else None
    for tag, group in (("all", []), ("name", ["name"]), ("parent", ["parent"]), ("both", ["name", "parent"])):
        rows = sums_after(rows, ["entity_type", "code", *group], "ord", {f"{tag}_n": weight, f"{tag}_s": ids}, some)
    orphan = F.col("parent").isNull()
    rows = rows.withColumns({f"{tag}_{c}": F.when(orphan, F.lit(0)).otherwise(F.col(f"{tag}_{c}")) for tag in ("parent", "both") for c in "ns"})

    near = written(near_names(plain, ratio, block))
    asks = near.join(plain, ["entity_type", "code", "name"]).withColumn("asks", F.lit(True))
    meets = near.join(plain.withColumnRenamed("name", "other"), ["entity_type", "code", "other"]).withColumn("asks", F.lit(False))
    both = asks.unionByName(meets)
    counted = {"n": F.when(~F.col("asks"), weight).otherwise(0), "s": F.when(~F.col("asks"), ids).otherwise(0)}
    group = ["entity_type", "code", "name", "other"]
    some = some and (hot if has_hot(both, group, hot) else None)
    both = sums_after(both, group, "ord", {f"near_{c}": v for c, v in counted.items()}, some)
    both = sums_after(both, [*group, "parent"], "ord", {f"kin_{c}": v for c, v in counted.items()}, some).filter("asks")
    kin = {c: F.when(orphan, F.lit(0)).otherwise(F.col(f"kin_{c}")) for c in "ns"}
    at = {f"near{level}_{c}": F.sum(F.when(F.col("level") == level, F.col(f"near_{c}")).otherwise(0)) for level in (1, 2) for c in "ns"}
    at |= {f"kin{level}_{c}": F.sum(F.when(F.col("level") == level, kin[c]).otherwise(0)) for level in (1, 2) for c in "ns"}
    found = both.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*(v.alias(k) for k, v in at.items()))
    rows = rows.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").na.fill(0, list(at))

    def of(level: int, parent: int, c: str) -> Column:
        """How many of a kind come after an entity (n), or the sum of their ids (s)."""
        col = lambda tag: F.col(f"{tag}_{c}")
        alike = {1: (col("near1"), col("kin1")), 2: (col("name") + col("near2"), col("both") + col("kin2"))}
        every, own = alike[level] if level else (col("all") - alike[1][0] - alike[2][0], col("parent") - alike[1][1] - alike[2][1])
        return own if parent else every - own

    def row(i: int, level: int, parent: int) -> Column:
        n, s = of(level, parent, "n"), of(level, parent, "s")
        return F.struct(F.lit(i).alias("kind"), (weight * n).alias("n"), F.when(n > 0, F.col("id")).alias("left"), (weight * (s - n * F.col("id"))).alias("spread"))

    kinds = rows.select(F.inline(F.array(*(row(i, *k) for i, k in enumerate(KINDS)))))
    totals = kinds.filter("n > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.min("left").alias("first_left"), F.sum("spread").alias("spread"))
    return totals.select(*_told(), "n", "first_left", "spread")


def _told(joined: bool = False) -> list[Column]:
    """confidence and reasons (an array, or joined to a text) of the column kind, a place in KINDS."""

    def picked(values: list[Column]) -> Column:
        return functools.reduce(lambda c, iv: c.when(F.col("kind") == iv[0], iv[1]), enumerate(values[:-1]), F).otherwise(values[-1])

    reasons = [F.lit("; ".join(r)) if joined else F.array(*map(F.lit, r)) for _, r in KINDS.values()]
    return [picked([F.lit(c) for c, _ in KINDS.values()]).alias("confidence"), picked(reasons).alias("reasons")]


def best_pairs(entities: DataFrame, ratio=name_ratio, block: int = BLOCK, joined: bool = False) -> DataFrame:
    """best_first of the candidate pairs.  Kinds stand in the order of their confidence, so what is sorted are three
    numbers a pair, without reasons."""
    pairs = kind_pairs(entities, ratio, block).orderBy(F.desc("kind"), "left_id", "right_id")
    return pairs.select("left_id", "right_id", *_told(joined))


def best_first(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("confidence"), "left_id", "right_id")


def merge_proposals(pairs: DataFrame) -> DataFrame:
    """Proposals to keep the left entity; none is ever applied by itself.  Reasons may be joined already."""
    told = F.col("reasons") if pairs.schema["reasons"].dataType == T.StringType() else F.array_join("reasons", "; ")
    return pairs.select("left_id", "right_id", "confidence", told.alias("justification"), F.lit(False).alias("auto_merge"))


SAME = ["entity_type", "code", "name", "parent"]


def _classes(entities: DataFrame) -> DataFrame:
    return entities.filter("code IS NOT NULL").groupBy(*SAME).agg(F.min_by("id", "ord").alias("class_id"), F.min("ord").alias("class_ord"), F.count("*").alias("members"))


def membership(entities: DataFrame) -> DataFrame:
    """(id, class_id, members): entities alike in type, code, name and parent are one class, named by its first member.
    Rows without a code have none."""
    classes = _classes(entities).select(*(F.col(c).alias(f"_{c}") for c in SAME), "class_id", "members")
    return entities.join(classes, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SAME]).select("id", "class_id", "members")


def representative_pairs(entities: DataFrame, ratio=name_ratio) -> DataFrame:
    """candidate_pairs between the first members of the classes: with membership, all pairs of a code that many copies
    share, without a row for each."""
    one = _classes(entities)
    return candidate_pairs(one.select(F.col("class_ord").alias("ord"), F.col("class_id").alias("id"), *SAME), ratio)
