"""Driver tables, and entities derived from them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def localities(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as localities under nations (provinces) and regions (zones), with a nullable coverage flag."""
    from terralith.operators.hierarchy import chain

    customer, nation, region = (read(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = chain(customer, [(nation, "c_nationkey", "n_nationkey"), (region, "n_regionkey", "r_regionkey")])
    covered = F.when(F.col("c_acctbal") < 0, False).when(F.col("c_acctbal") > 5000, True)
    return joined.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nom"), F.col("n_name").alias("province"), F.col("r_name").alias("zone"), F.col("c_mktsegment").alias("activite_principale"), covered.alias("couverture_4g"), "c_acctbal")


def order_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile a customer that has orders: population (number of orders times 1000) and a priority score."""
    orders = read(spark, folder, "orders")
    return orders.groupBy(F.col("o_custkey").alias("localite_id")).agg((F.count("*") * 1000).alias("population"), F.round(F.avg("o_totalprice") / 5000, 2).alias("score_priorite"))


LOCALITIES_SQL = """localities AS (
  SELECT c_custkey AS id, c_name AS nom, n_name AS province, r_name AS zone, c_mktsegment AS activite_principale,
         CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal > 5000 THEN true END AS couverture_4g, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), profiles AS (
  SELECT o_custkey AS localite_id, CAST(count(*) * 1000 AS BIGINT) AS population, round(avg(o_totalprice) / 5000, 2) AS score_priorite
  FROM orders GROUP BY o_custkey
)"""
