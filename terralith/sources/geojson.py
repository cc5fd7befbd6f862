"""GeoJSON and JSON documents as rows."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "file string, layer string, ord long, folder string, geometry_type string, geometry string, properties map<string,string>, error string"


def _rows(file: str, layer: str, text: str) -> list[tuple]:
    try:
        doc = json.loads(text)
    except ValueError as e:
        return [(file, layer, None, None, None, None, {}, str(e))]
    if not isinstance(doc, dict) or doc.get("type") != "FeatureCollection":
        return [(file, layer, None, None, None, None, {}, "FeatureCollection attendue")]
    out = []
    for i, f in enumerate(doc.get("features") or []):
        p, g = f.get("properties") or {}, f.get("geometry") or {}
        folder = p.get("folder") or p.get("layer") or layer
        plain = {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in p.items() if v is not None}
        out.append((file, layer, i, str(folder), g.get("type"), json.dumps(g) if g else None, plain, None))
    return out


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            data = bytes(content)
            stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            if data[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    parts = [(n.rsplit("/", 1)[-1].rsplit(".", 1)[0], z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith((".geojson", ".json"))]
            else:
                parts = [(stem, data.decode("utf-8", "replace"))]
            rows = [r for layer, text in parts for r in _rows(file, layer, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.replace("map<string,string>", "map").split(", ")]).astype(object)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature of GeoJSON files or of zip archives of them."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(features, FEATURES)


def read_records(spark: SparkSession, path: str, key: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows of a JSON document: its list under `key`, or the whole document if it is a list.  With a schema of the rows
    a missing file is an empty table, as a report that isn't written yet; without one it is an error."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    doc = spark.read.json(path, multiLine=True)
    if key is None:
        lists = [f.name for f in doc.schema.fields if f.dataType.typeName() == "array"]
        key = "features" if "features" in lists else lists[0] if lists and len(doc.columns) > 0 and not {"nom", "code"} & set(doc.columns) else None
    return doc if key is None else doc.select(F.inline(F.col(key)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, in any file system that Spark reads, matches a file or folder."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = name.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(name)
    return found is not None and len(found) > 0


def layer_level(layer: Column) -> Column:
    """Administrative level from a boundary layer's name."""
    name = F.lower(layer)
    out = None
    for part, level in (("admin0", "pays"), ("admin1", "province"), ("admin2", "territoire"), ("admin3", "collectivite"), ("capital", "chef_lieu")):
        out = F.when(name.contains(part), level) if out is None else out.when(name.contains(part), level)
    return out.otherwise("unknown")
