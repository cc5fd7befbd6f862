"""Parent resolution by ordered rules: each rule is an equi-join, the first that finds a parent counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.text import alnum_key, blank_to_null
from terralith.operators.windows import keep_first, keep_last


@dataclass(frozen=True)
class Rule:
    """child: key expressions over the rows; parent: key columns of the parents; level: what is found; keep: which
    parent counts of several with equal keys, in the order of column `ord`."""

    label: str
    child: tuple[Column, ...]
    parents: DataFrame
    parent: tuple[str, ...]
    level: str
    keep: str = "last"


def ordered_fallback_join(df: DataFrame, rules: list[Rule], fields: list[str], none: str = "non rattaché") -> DataFrame:
    """df with `fields` of the first rule that matches, `resolution` (its label) and `parent_level`.

    Blank and null keys never match.  Each rule's parents are reduced to one row a key first, so no row of df is
    doubled.
    """
    out = df
    for i, rule in enumerate(rules):
        keys = [f"_k{i}_{j}" for j in range(len(rule.parent))]
        known = rule.parents
        for name, column in zip(keys, rule.parent):
            known = known.withColumn(name, blank_to_null(F.col(column).cast("string")))
        known = known.dropna(subset=keys)
        # places restart in every file, so the fields break ties
        known = known.withColumn("_place", F.struct("ord", *fields))
        known = (keep_last if rule.keep == "last" else keep_first)(known, keys, "_place")
        known = known.select(*keys, F.struct(*fields).alias(f"_p{i}"))
        on = None
        for name, child in zip(keys, rule.child):
            same = blank_to_null(child.cast("string")) == F.col(name)
            on = same if on is None else on & same
        out = out.join(known, on, "left").drop(*keys)
    found = F.coalesce(*(F.col(f"_p{i}") for i in range(len(rules))))
    label = F.coalesce(*(F.when(F.col(f"_p{i}").isNotNull(), r.label) for i, r in enumerate(rules)), F.lit(none))
    level = F.coalesce(*(F.when(F.col(f"_p{i}").isNotNull(), r.level) for i, r in enumerate(rules)))
    picked = out.withColumn("_found", found).withColumn("resolution", label).withColumn("parent_level", level)
    return picked.select(*df.columns, *(F.col(f"_found.{f}").alias(f) for f in fields), "resolution", "parent_level")


def find_territories(df: DataFrame, name: Column, province: Column, province_code: Column, territories: DataFrame, fields: list[str]) -> DataFrame:
    """df with `fields` of the territory of that name in the province (by name, else by code), else of the first
    territory of that name anywhere.  territories (ord, nom, province, province_code, ...)."""
    known = territories.withColumn("_name", alnum_key("nom")).withColumn("_province", alnum_key("province")).withColumn("_code", alnum_key("province_code"))
    rules = [
        Rule("province", (alnum_key(province), alnum_key(name)), known, ("_province", "_name"), "territoire"),
        Rule("code province", (alnum_key(province_code), alnum_key(name)), known, ("_code", "_name"), "territoire"),
        Rule("nom", (alnum_key(name),), known, ("_name",), "territoire", "first"),
    ]
    return ordered_fallback_join(df, rules, fields)
