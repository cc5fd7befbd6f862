"""Writers: CSV, JSON lines, GeoJSON features, KML placemarks, reports, run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.functions.text import xml_escape
from terralith.operators.geometry import kml
from terralith.sources import committed


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, every field quoted, quotes doubled."""
    df.select(*(F.col(c).cast("string") for c in df.columns)).write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True, escape='"')


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """One GeoJSON feature a line, which scales where one collection wouldn't."""
    features.select(column).write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, column: str = "feature", most: int = 10_000) -> str:
    """A small layer as one FeatureCollection; larger ones are refused (write_features has no limit)."""
    rows = features.select(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features")
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in rows) + "]}"


def placemark(name: Column, lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("<Placemark><name>"), xml_escape(F.coalesce(name, F.lit(""))), F.lit("</name><Point><coordinates>"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("</coordinates></Point></Placemark>"))


def shape_placemark(name: Column, geometry: Column) -> Column:
    """A placemark with a whole geometry (see operators.geometry)."""
    return F.concat(F.lit("<Placemark><name>"), xml_escape(F.coalesce(name, F.lit(""))), F.lit("</name>"), kml(geometry), F.lit("</Placemark>"))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def kml_document(placemarks: DataFrame, path: str, name: str, column: str = "placemark") -> None:
    """KML documents of a bounded number of placemarks in the folder `path`, written by all tasks, and one that links them
    (see committed)."""
    committed.write(placemarks.select(column), path, "kml", name, overwrite=True)


def write_twice(df: DataFrame, folder: str, stem: str, as_json: bool = True) -> list[str]:
    """The same result under its own name and as the latest one: computed once, then copied.  Returns both paths."""
    paths = [f"{folder}/{stem}.catalog", f"{folder}/latest.catalog"]
    (df.write.mode("overwrite").json if as_json else df.write.mode("overwrite").parquet)(paths[0])
    reader = df.sparkSession.read.schema(df.schema)
    first = reader.json(paths[0]) if as_json else reader.parquet(paths[0])
    (first.write.mode("overwrite").json if as_json else first.write.mode("overwrite").parquet)(paths[1])
    return paths


def write_manifest(spark, paths: list[str], path: str) -> None:
    """The created files, one row each."""
    spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "ord int, created_file string").coalesce(1).write.mode("overwrite").json(path)


def append_run(df: DataFrame, path: str, source: str, as_of: str) -> None:
    """Append a run's action counts (action, reason, n) to the history."""
    df.withColumn("source", F.lit(source)).withColumn("as_of", F.lit(as_of)).write.mode("append").parquet(path)
