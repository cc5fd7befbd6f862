"""Importance resampling towards a target distribution, over hashed word n-grams.

Two passes over whole texts in Arrow batches.  The first counts the buckets of all features: one vector of BUCKETS
numbers a partition by np.bincount, vectors merged by treeReduce.  From the counts of the corpus and of the target
texts comes a gain for each bucket.  The second pass gathers the broadcast gains of a document's features and sums them
by document with np.bincount.  Documents then compete by weight plus Gumbel noise of their id; the highest are drawn.
Ranks come from ranges of the sorted scores and the sizes of the ranges before, so no task sorts all documents.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import array_slices, joined_bytes, materialize, record_batch, segments, table, text_or_empty, text_slices

BUCKETS = 10_000
#: Features are runs of one to so many words.
WIDTH = 3
#: Only documents with at least so many words are drawn, and so many of a hundred of them.
LEAST_WORDS, PERCENT = 20, 5
SEED = "42"
#: Words of more bytes than this are hashed one at a time.
_LONG = 64
#: Vectors that one task of a merge adds up, about.
_FAN_IN = 32

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
_LOWER = bytes(b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256))


@functools.lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """The register after one byte, for each low byte of it: eight shifts by the reflected polynomial of CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


def _fed(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes data[start:end], all words a byte further at a time, the longest first."""
    table, length = _crc_table(), ends - starts
    order = np.argsort(-length, kind="stable")
    at, reg, left = starts[order], register[order], -length[order]
    for i in range(int(np.searchsorted(left, -_LONG))):  # longer than _LONG
        word = data[at[i] : at[i] - left[i]].tobytes()
        reg[i] = zlib.crc32(word, int(reg[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    first = int(np.searchsorted(left, -_LONG))
    for k in range(int(-left[first]) if first < len(left) else 0):
        n = int(np.searchsorted(left, -k))  # words of more than k bytes
        part = reg[first:n]
        reg[first:n] = table[(part ^ data[at[first:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, the number of the text that each belongs to, and the words of each text."""
    data, at = joined_bytes(texts)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    starts, ends = segments(data, _WORD[data])
    cuts = np.searchsorted(starts, at)
    words = np.diff(cuts)
    owner = np.repeat(np.arange(len(texts)), words)
    register = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    buckets, owners = [], []
    for k in range(WIDTH):
        if k:  # one word further, after a space
            register = register[: max(0, len(starts) - k)]
            register = _crc_table()[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
        register = _fed(register, data, starts[k:], ends[k:])
        inside = owner[k:] == owner[: max(0, len(owner) - k)]
        buckets.append((register[inside] ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS))
        owners.append(owner[k:][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), words


def _bucket_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vector of counts a partition, zeros for an empty one."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in text_slices(batches, "text", 1 << 18):
        counts += np.bincount(features(part.column("text").to_pylist())[0], minlength=BUCKETS)
    yield record_batch(counts=[counts.tobytes()])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of the whole column `text` fall into each bucket; null texts have none."""
    vectors = texts.select(text_or_empty().alias("text")).mapInArrow(_bucket_vectors, "counts binary").rdd
    n = vectors.getNumPartitions()
    if not n:
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, math.ceil(math.log(n, _FAN_IN)))
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor of 1000 times the log ratio of the target's smoothed share to the corpus's."""
    big, small = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * big / ((s + 1) * small))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text") -> F.Column:
    """A struct of n_words, n_features and weight (the sum of gains over its features) for the column `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def of_texts(texts: pa.Array) -> pa.Array:
        found = [np.zeros((3, 0), np.int64)]
        for part in array_slices(texts, 1 << 18):
            buckets, owner, words = features(texts[part].to_pylist())
            # sums of integers below 2^53 are exact in doubles
            found.append(np.stack([words, np.bincount(owner, minlength=len(words)), np.bincount(owner, shared.value[buckets], len(words)).astype(np.int64)]))
        columns = np.concatenate(found, axis=1)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n_words", "n_features", "weight"])

    return of_texts(text_or_empty(text))


def gumbel(doc_id: str = "doc_id", seed: str = SEED) -> F.Column:
    """Noise of an id: floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of `seed:id`; a null id is empty."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(rows: DataFrame, count: int, order: list[F.Column], keep: list[str]) -> DataFrame:
    """The first `count` of rows (all, if fewer) in `order` with their `rank` from 1, and the others without: columns
    `keep` and rank.  Rows go to ranges of the order; the sizes of the ranges before give where a range begins.  Rows that
    tie are dealt out too, in any order."""
    order = [*order, F.col("_tie")]
    ranged = rows.select(*keep, F.monotonically_increasing_id().alias("_tie")).repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()))
    # one row a range
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    placed = ranged.join(F.broadcast(materialize(starts, 1)), F.col("_range") == F.col("_r"))
    rank = (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_start")).cast("long")
    drawn = placed.filter(F.col("_start") < count).withColumn("rank", rank)
    drawn = drawn.select(*keep, F.when(F.col("rank") <= count, F.col("rank")).alias("rank"))
    return drawn.unionByName(placed.filter(F.col("_start") >= count).select(*keep, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Of docs (doc_id, text) and target texts (text): every document's doc_id, n_words, n_features, weight, score and
    rank (null if not drawn).  Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn,
    the highest scores first, ties to the smaller doc_id (null ids last).

    Null text is empty; a text without words has no feature and weight 0; repeated rows are rows of their own, with equal
    scores and ranks that follow each other.  Without documents the result is empty; without target texts every
    bucket is weighed against an empty target.  Other columns are ignored.  Whole texts are read.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    found = docs.select("doc_id", weighed(docs, gain).alias("_w")).select("doc_id", "_w.*")
    scored = materialize(found.withColumn("score", F.col("weight") + gumbel(seed=seed)))
    keep = ["doc_id", "n_words", "n_features", "weight", "score"]
    enough = F.col("n_words") >= least_words
    count = percent * scored.filter(enough).count() // 100
    drawn = ranked(scored.filter(enough), count, [F.desc("score"), F.asc_nulls_last("doc_id")], keep)
    return drawn.unionByName(scored.filter(~enough).select(*keep, F.lit(None).cast("long").alias("rank")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
