"""Tables written to the folder that all executors share, for rows that several steps must read alike."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used by a session with a local master that names no folder.
LOCAL = "file:///tmp/checkpoints"


def base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as a URI of Hadoop's; a session on a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = LOCAL
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


#: Folders named so far by each application.
_MADE: dict[str, list[str]] = {}


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder."""
    name = f"{base(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def drop(spark: SparkSession) -> int:
    """Delete the folders that this application has made here, and return their number: for callers that have written
    what they want, as results that are not written yet read them."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for name in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df as a table of its own: what comes after neither computes it again nor loses it with an executor.  With
    partition_by (an int column) a filter on that column reads only its files."""
    spark = df.sparkSession
    path = folder(spark, "table")
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    return read.select(*df.columns)


def ranged(df: DataFrame, order: list, out: str = "_stretch", partitioned: bool = False) -> DataFrame:
    """df, written, with the number of each row's range in `order` (columns or expressions).  Bounds come from a sample
    of the rows, so ranges hold about as many rows each whatever the values; rows that agree in `order` share a range,
    and a greater number means greater values."""
    rows = df.repartitionByRange(*order).withColumn(out, F.spark_partition_id())
    return written(rows, out if partitioned else None)
