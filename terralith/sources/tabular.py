"""CSV sources and headers: separators, columns by alias, required columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.functions.text import header_compact


def sniff_separator(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All columns as text, empty as null, blank lines dropped."""
    sep = separator or sniff_separator(spark, path)
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, quote='"', escape='"', multiLine=True, nullValue="").dropna(how="all")


def detect_columns(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Field -> header: an exact alias first, then an alias that a header contains (blank headers never match)."""
    compact = {h: header_compact(h) for h in headers}
    out: dict[str, str] = {}
    for field, names in aliases.items():
        wanted = [header_compact(n) for n in names]
        exact = next((h for h in headers if compact[h] and compact[h] in wanted), None)
        part = next((h for h in headers if compact[h] and any(w and w in compact[h] for w in wanted)), None)
        if exact or part:
            out[field] = exact or part
    return out


def detect_sheet(sheets: list[str], wanted: str) -> str | None:
    """The sheet of that name, else one that contains it, else the only one."""
    key = header_compact(wanted)
    exact = [s for s in sheets if header_compact(s) == key]
    part = [s for s in sheets if key in header_compact(s)]
    return (exact or part or (sheets if len(sheets) == 1 else [None]))[0]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*(F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(field) for field, h in mapping.items()))


def mapped(df: DataFrame, profile: dict[str, dict]) -> DataFrame:
    """Canonical fields from a declarative profile: {field: {"from": [columns], "default": value, "transform": f}}.
    The first non-blank source counts; transform is a function from Column to Column."""
    out = []
    for field, rule in profile.items():
        sources = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in rule["from"] if c in df.columns]
        value = F.coalesce(*sources, F.lit(rule.get("default"))) if sources else F.lit(rule.get("default")).cast("string")
        out.append(rule.get("transform", lambda c: c)(value).alias(field))
    return df.select(*out)


def parse_zones(text: str) -> list[tuple[str, str, str, str]]:
    """(code, name, colour, province) rows of a zone configuration: 'zones:' with items of code, nom, couleur and a list
    of provinces.  A small configuration file, read on the driver."""
    rows, zone, in_list = [], {}, False
    for line in text.splitlines():
        body = line.split(" #", 1)[0].rstrip()
        item = re.fullmatch(r"\s*-\s+(\w+):\s*(.*)", body)
        pair = re.fullmatch(r"\s+(\w+):\s*(.*)", body)
        entry = re.fullmatch(r"\s*-\s+(.+)", body)
        if item:
            zone, in_list = {item[1]: item[2].strip("\"' ")}, False
        elif pair:
            in_list = pair[1] == "provinces"
            zone[pair[1]] = pair[2].strip("\"' ")
        elif entry and in_list:
            rows.append((zone.get("code", ""), zone.get("nom", ""), zone.get("couleur", ""), entry[1].strip("\"' ")))
    return rows


def zone_table(spark: SparkSession, text: str, version: str) -> DataFrame:
    return spark.createDataFrame(parse_zones(text), "code string, name string, colour string, province string").withColumn("config_version", F.lit(version))
