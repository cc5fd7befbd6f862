"""Exact token-length histogram and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import materialize, table, text_or_empty, text_slices
from terralith.llm.vocab import byte_encoder, default_path

#: Lengths are summed in blocks of this many, blocks are then summed.
BLOCK = 1024


def token_lengths(docs: DataFrame, ranks_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs its columns `keep` and n_tokens, the number of byte-level BPE tokens of the whole text (null:
    0; strings that look like special tokens are ordinary text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(ranks_path or default_path("byte_bpe_50k.tiktoken")).encode_ordinary
        for part in text_slices(batches):
            n = pa.array([len(encode(t)) for t in part.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], [*part.schema.names[:-1], "n_tokens"])

    kept = docs.select(*keep, text_or_empty().alias("_text"))
    return kept.mapInArrow(count, ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[:-1]), "n_tokens long"]))


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): partial counts in each task, one row a length in the result."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row a length L that occurs: n_docs of that length; docs_at_least and tokens_at_least (length >= L);
    docs_below, tokens_below (length < L); truncated_tokens, the total if texts were cut at L.

    Sums run within blocks of BLOCK lengths; block totals, at most longest / BLOCK + 1 rows, give the offsets.  The
    size of the histogram is bounded by the longest text, not by the number of documents.  Empty input: no rows.
    """
    hist = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    below = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("_block").alias("_b"),
        *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_before") for c in ("_d", "_t")),
        *(F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("_d", "_t")),
    )
    inner = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = hist.withColumn("_di", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("_ti", F.coalesce(F.sum("_tokens").over(inner), F.lit(0)))
    out = out.join(blocks, F.col("_block") == F.col("_b"))
    out = out.withColumn("docs_below", F.col("_d_before") + F.col("_di")).withColumn("tokens_below", F.col("_t_before") + F.col("_ti"))
    out = out.withColumn("docs_at_least", F.col("_d_all") - F.col("docs_below")).withColumn("tokens_at_least", F.col("_t_all") - F.col("tokens_below"))
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_below", "tokens_below", (F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"))


def context_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: n_docs, total_tokens, docs_over (longer than the limit), kept_tokens (texts cut at the
    limit).  Answered by the first length at or above each limit; no document is looked at again."""
    asked = sums.sparkSession.createDataFrame([(int(x), 1) for x in limits], "context long, _one int")
    total = sums.agg(F.lit(1).alias("_one"), F.max(F.col("docs_below") + F.col("docs_at_least")).alias("n_docs"), F.max(F.col("tokens_below") + F.col("tokens_at_least")).alias("total_tokens"))
    above = sums.withColumn("context", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits)))).filter(F.col("n_tokens") > F.col("context"))
    first = above.groupBy("context").agg(F.min_by(F.struct("docs_at_least", "tokens_below"), "n_tokens").alias("_f"))
    out = asked.join(first, "context", "left").join(total, "_one")
    over = F.coalesce(F.col("_f.docs_at_least"), F.lit(0))
    return out.select("context", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), over.alias("docs_over"), (F.coalesce(F.col("_f.tokens_below"), F.col("total_tokens"), F.lit(0)) + over * F.col("context")).alias("kept_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Per share q the smallest length at which at least q of all documents are no longer (exact, nearest rank)."""
    asked = sums.withColumn("share", F.explode(F.array(*(F.lit(float(q)) for q in shares))))
    reached = F.col("docs_below") + F.col("n_docs") >= F.ceil(F.col("share") * (F.col("docs_below") + F.col("docs_at_least")))
    return asked.filter(reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each token length that occurs in `documents`."""
    return suffix_sums(materialize(histogram(token_lengths(table(spark, sf_dir, "documents")))))
