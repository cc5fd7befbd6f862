"""Substring search over an index of trigrams, so that a query reads the postings of its own trigrams and the texts that
these point to, not all texts.

The index is four tables in a folder: `texts` (the searched text and the rows it belongs to, in parts by a hash of the
key), `postings` (trigram, part, key; in buckets by a hash of the trigram, sorted), `sizes` (trigram, rows that hold it)
and `shape` (how many parts and buckets there are).  It is built once, by one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a gram; shorter terms have none and are looked for in all texts.
GRAM = 3
#: A query meets the postings of so many of its rarest trigrams; hits are verified on the text.
PROBES = 4


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, overlapping ones included, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def term_grams(term: str) -> list[str]:
    return sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})


def _spot(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def build(rows: DataFrame, keep: list[str], text: Column, path: str, parts: int = 64, buckets: int = 256) -> TextIndex:
    """Index the columns `keep` of rows by `text` (rows with null text are left out) in the folder `path`, which is
    overwritten.  `parts` and `buckets` should make files of some hundred megabytes.  Rows that agree in all columns stay
    rows of their own; that two others share a key costs a look at one more text, no hit."""
    spark = rows.sparkSession
    keyed = rows.select(*keep, F.lower(text).alias("_text")).filter("_text IS NOT NULL")
    keyed = keyed.withColumn("_key", F.xxhash64(*keep)).withColumn("_part", _spot(F.col("_key"), parts))
    # a part may have many files, so that a hot key is no single task
    keyed.repartitionByRange("_part", "_key").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    found = texts.select("_key", "_part", F.explode(grams(F.col("_text"))).alias("gram"))
    found = found.withColumn("_bucket", _spot(F.col("gram"), buckets))
    # ranges, not hashes: the postings of a frequent trigram take several tasks and files
    found.repartitionByRange("_bucket", "gram", "_key").sortWithinPartitions("_bucket", "gram").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("_bucket", "gram").agg(F.count("*").alias("n")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/sizes")
    spark.createDataFrame([(parts, buckets)], "parts int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    return TextIndex(spark, path)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.parts, self.buckets = spark.read.parquet(f"{path}/shape").first()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _of_grams(self, name: str, wanted: list[str]) -> DataFrame:
        """Rows of a table for these trigrams: only their buckets are read."""
        spots = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_spot(F.col("gram"), self.buckets)).distinct().collect()
        return self._table(name).filter(F.col("_bucket").isin([r[0] for r in spots]) & F.col("gram").isin(wanted))

    def rarest(self, term: str, probes: int = PROBES) -> list[str] | None:
        """The term's trigrams that the fewest rows hold; None if a trigram is in no row, and so the term neither."""
        wanted = term_grams(term)
        sizes = {r["gram"]: r["n"] for r in self._of_grams("sizes", wanted).collect()}  # one row a trigram of the term
        return sorted(wanted, key=lambda g: (sizes[g], g))[:probes] if len(sizes) == len(wanted) else None

    def candidates(self, wanted: list[str]) -> DataFrame:
        """(_part, _key) of the rows that hold all these trigrams."""
        met = self._of_grams("postings", wanted).groupBy("_part", "_key").agg(F.count_distinct("gram").alias("n"))
        return met.filter(F.col("n") == len(wanted)).select("_part", "_key")

    def search(self, term: str) -> DataFrame:
        """The indexed rows whose text contains the term, in any case; % and _ stand for themselves.  A term of fewer
        than three letters is looked for in all texts, the empty one is in each."""
        term, texts = term.lower(), self._table("texts")
        columns = [c for c in texts.columns if c not in ("_text", "_key", "_part")]
        if len(term) < GRAM:
            return texts.filter(F.col("_text").contains(term)).select(*columns)
        wanted = self.rarest(term)
        if wanted is None:
            return texts.limit(0).select(*columns)
        hits = self.candidates(wanted)
        # at most `parts` numbers: the folders of texts that are read at all
        touched = [r[0] for r in hits.select("_part").distinct().collect()]
        held = hits.select(F.col("_key").alias("_hit"), F.col("_part").alias("_in"))
        here = texts.filter(F.col("_part").isin(touched))
        met = here.join(held, (F.col("_part") == F.col("_in")) & (F.col("_key") == F.col("_hit")), "left_semi")
        return met.filter(F.col("_text").contains(term)).select(*columns)
