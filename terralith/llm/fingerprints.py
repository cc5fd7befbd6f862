"""Document fingerprints: a threshold-scaled sketch of five-word shingles.

Every shingle is hashed to 64 bits; the sketch keeps each hash below a fixed fraction of the hash range, and always the
least hash, so that no text with words has an empty sketch.  There is one fraction for texts of all lengths.  Sketches
of parts of a corpus merge exactly: the sketch of two texts' shingles together is the union of their sketches, without
a hash above the threshold that is no longer the least.  The share of one sketch that another holds estimates
containment, however unequal the two texts are.

DataFrame functions only: words by split, hashes by xxhash64, sets by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import clear_of, materialize, table, text_or_empty

WIDTH = 5
#: The kept fraction is 2 ** -SCALE_BITS.
SCALE_BITS = 2
_WHITE = r"[ \t\n\x0B\f\r]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words (runs of characters other than ASCII white space) in order."""
    words = F.filter(F.split(F.lower(text), _WHITE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of each run of `width` words; one hash of all words if there are fewer; none without words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def threshold(bits: int = SCALE_BITS) -> int:
    """Hashes, as signed numbers, are kept below this: the lowest 2 ** -bits of the range."""
    return -(1 << 63) + (1 << (64 - bits))


def _kept(hashes: Column, bits: int) -> Column:
    """Hashes below the threshold; the least, if it is not among them; none of none."""
    low = F.filter(hashes, lambda h: h < threshold(bits))
    return F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.array_compact(F.array(F.array_min(hashes))))


def with_sketch(df: DataFrame, text: str, out: str, bits: int = SCALE_BITS) -> DataFrame:
    """df with `out`: the sketch of column `text`, the sorted distinct hashes that are kept.  A text without words
    (null, empty, white) has an empty sketch."""
    words, all_hashes, low = (clear_of(c, df.columns) for c in ("words", "all", "low"))
    # columns of their own: an expression within a lambda would be computed anew for each element
    df = df.withColumn(words, word_hashes(F.col(text))).withColumn(all_hashes, F.array_distinct(shingle_hashes(F.col(words))))
    df = df.withColumn(low, F.filter(all_hashes, lambda h: h < threshold(bits)))
    kept = F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.array_compact(F.array(F.array_min(all_hashes))))
    return df.withColumn(out, kept).drop(words, all_hashes, low)


def merge(a: Column, b: Column, bits: int = SCALE_BITS) -> Column:
    """The sketch of both texts' shingles together: exactly the sketch of the union."""
    return _kept(F.array_union(a, b), bits)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all shingles of two texts: the share of common hashes in both sketches'
    union.  1 for equal sketches, two empty ones too, and 0 if only one of them is empty.  (A hash above the threshold
    is in a sketch only alone, so it counts only where the other sketch is the same.)"""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).when(both > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty.  If a's only hash lies above the threshold (few
    shingles: one in four texts of five shingles), 1 if b's sketch has it and else 0."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def render(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_ids(ids: DataFrame, parts: int | None = None) -> DataFrame:
    """ids (_id, distinct, never null; other columns stay) with next_id: the next greater one, after the greatest
    the least.

    Ids are dealt out by range; each range finds its successors, and a table of one row a range gives the successor
    of each range's last id.
    """
    parts = parts or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.repartitionByRange(parts, "_id").withColumn("_part", F.spark_partition_id()))
    firsts = ranged.groupBy("_part").agg(F.min("_id").alias("_first"))
    after = F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.min("_first").over(Window.partitionBy()))
    firsts = firsts.select(F.col("_part").alias("_p"), after.alias("_after"))
    own = ranged.withColumn("_next", F.lead("_id").over(Window.partitionBy("_part").orderBy("_id")))
    return own.join(firsts, F.col("_part") == F.col("_p")).select(*ids.columns, F.coalesce("_next", "_after").alias("next_id"))


#: Stands for a null doc_id, so that both joins below find the documents dealt out by the same, never null, key.
_NULL_ID = -(1 << 63)


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; other columns ignored): doc_id, n_chars, text, sketch, edited and next_sketch.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document, the one with the next greater doc_id; after the greatest id comes the least.  Null text is empty; a
    null id is the least.  Of rows that share an id, the one with the least such beginning stands for it; each of
    them keeps its own row.  A document without others is its own next.  An empty table gives no rows.  Documents
    are shuffled once, by id; apart from them, only beginnings as long as needed are sent, with their sketches.
    """
    full = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_id"), text_or_empty().alias("text"))
    needs = full.groupBy("_id").agg(F.floor(F.max(F.char_length("text")) / 4).cast("int").alias("_need"))
    links = materialize(next_ids(needs)).withColumnRenamed("_id", "_for")
    sketched = with_sketch(full, "text", "sketch")
    heads = sketched.join(links, F.col("_id") == F.col("next_id"))
    heads = heads.select("_for", F.struct(F.expr("substring(text, 1, _need)").alias("head"), F.col("sketch").alias("sketch")).alias("_next"))
    heads = heads.groupBy("_for").agg(F.min("_next").alias("_next"))
    joined = sketched.join(heads, F.col("_id") == F.col("_for"), "left")
    joined = joined.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - _cut)"), F.expr("coalesce(substring(_next.head, 1, _cut), '')"))
    own_id = F.when(F.col("_id") != _NULL_ID, F.col("_id"))
    return joined.select(own_id.alias("doc_id"), "n_chars", "text", "sketch", edited.alias("edited"), F.col("_next.sketch").alias("next_sketch"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likeness and containment between them."""
    both = with_sketch(with_edits(table(spark, sf_dir, "documents")), "edited", "edited_sketch")
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        render(own).alias("fingerprint"), render(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), F.coalesce(likeness(own, following), F.lit(0.0)).alias("near_next"),
        containment(own, edited).alias("inside_edited"), F.coalesce(containment(own, following), F.lit(0.0)).alias("inside_next"),
    )
