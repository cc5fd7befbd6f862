"""Readers and writers.  `read(spark, path)` picks a reader by the path's extension."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.sources import committed, geojson, kml, shapefile, sinks, tabular, xlsx


class FormatNotSupported(ValueError):
    """No reader for this extension."""


READERS = {
    "kml": kml.read_placemarks,
    "kmz": kml.read_placemarks,
    "geojson": geojson.read_features,
    "json": geojson.read_records,
    "csv": tabular.read_csv,
    "xlsx": xlsx.read_cells,
    "dbf": shapefile.read_attributes,
    "shp": shapefile.read_attributes,
}


def read(spark: SparkSession, path: str) -> DataFrame:
    extension = path.rsplit(".", 1)[-1].lower()
    if extension not in READERS:
        raise FormatNotSupported(extension)
    return READERS[extension](spark, path)


#: Writers by kind: of folders of lines (csv, jsonl, geojson), and of committed documents (see committed).
WRITERS = {
    "csv": sinks.write_csv,
    "jsonl": sinks.write_json,
    "geojson": sinks.write_features,
    **{kind: functools.partial(committed.write, kind=kind) for kind in committed.MOST_ROWS},
}


def write(df: DataFrame, path: str, kind: str, **how) -> None:
    """df in the format of a kind; an unknown one is an error."""
    if kind not in WRITERS:
        raise FormatNotSupported(kind)
    WRITERS[kind](df, path, **how)


#: Formats that are known without a reader (fixed values).
UNREAD = ("gpkg",)


def explore(spark: SparkSession, path: str) -> tuple[str, DataFrame | None, list[str]]:
    """(format, rows, warnings) of a path, as a catalogue of files needs it: a format without a reader has no rows and a
    warning instead of an error."""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension in READERS:
        return extension, read(spark, path), []
    return extension, None, [f"{extension}: format connu, non lu" if extension in UNREAD else f"{extension or path}: format inconnu"]


def key_ranges(spark: SparkSession, url: str, table: str, key: str, tasks: int, **options: str) -> list[str]:
    """Conditions that cut a table into at most `tasks` ranges of a numeric key with about as many rows each, rows without
    a key in the first.  Bounds are quantiles of the key column, which alone is read for them, in ranges of equal width.
    A value that a large share of the rows has is a range of its own: a key cannot cut it further."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = reader.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {table}").load().first()
    if low is None or low == high:
        return ["1 = 1"]
    keys = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(tasks), **options).load().select(key)
    column = keys.columns[0]
    probes = [i / tasks for i in range(1, tasks)]
    kind = int if keys.dtypes[0][1] in ("tinyint", "smallint", "int", "bigint") or keys.dtypes[0][1].endswith(",0)") else float
    cuts = keys.select(keys[column].cast("double")).dropna().approxQuantile(column, probes, 0.1 / tasks)
    cuts = sorted({kind(c) for c in cuts if low < c <= high})
    if not cuts:
        return [f"{key} = {low} OR {key} IS NULL", f"{key} > {low}"]
    middle = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *middle, f"{key} >= {cuts[-1]}"]


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, tasks: int = 32, **options: str) -> DataFrame:
    """A database table.  With a numeric key it is read in up to `tasks` ranges of about as many rows (see key_ranges),
    else in one task.  Filters and columns of what follows go to the database."""
    if key is None:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return spark.read.jdbc(url, table, predicates=key_ranges(spark, url, table, key, tasks, **options), properties=options)


#: Sources of the referentials (fixed values): name, role; none is connected by itself.
SOURCES = (("kml", "geometrie"), ("xlsx", "nomenclature"), ("geojson", "limites"), ("csv", "zones"))
#: Sources that are announced without a loader (fixed values).
ANNOUNCED = ("ceni", "caid", "ins")
LOADERS: dict = {}


def register_loader(kind: str, loader) -> None:
    """loader(spark, **request) returns a DataFrame."""
    LOADERS[kind] = loader


def run(spark: SparkSession, kind: str, **request) -> DataFrame:
    """The rows of a source; an announced one isn't implemented, an unknown one is an error."""
    if kind in LOADERS:
        return LOADERS[kind](spark, **request)
    if kind in ANNOUNCED:
        raise NotImplementedError(kind)
    raise KeyError(kind)


def registry(spark: SparkSession) -> DataFrame:
    """(source, role, connected, loader): what is known of each source."""
    rows = [(name, role, False, name in LOADERS or name in READERS) for name, role in SOURCES] + [(name, "annonce", False, name in LOADERS) for name in ANNOUNCED]
    return spark.createDataFrame(rows, "source string, role string, connected boolean, loader boolean")


def source_rows(spark: SparkSession, records: DataFrame, source: str = "source") -> DataFrame:
    """The registry with the number of records of each source, and the sources of records that it doesn't know."""
    counts = records.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("_n"))
    both = registry(spark).join(counts, F.col("source") == F.col("_s"), "full_outer")
    role = F.when(F.col("source").isNotNull(), F.col("role")).otherwise("inconnue")
    return both.select(F.coalesce("source", "_s").alias("source"), role.alias("role"), F.coalesce("loader", F.lit(False)).alias("loader"), F.coalesce("_n", F.lit(0)).alias("records"), F.col("_n").isNotNull().alias("connected"))


def content_digest(content: Column) -> Column:
    """Identity of a file's or document's content: SHA-256 in hex, of no bytes if there is none."""
    return F.sha2(F.coalesce(content, F.lit("").cast("binary")), 256)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below the path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", content_digest(F.col("content")).alias("sha256"))
