"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Document frequencies of five-word shingles.  Only shingles in at least one of RARE documents have an idf of their
   own; a first pass finds candidates (a shingle that frequent is as frequent in some block), a second counts them
   exactly.  idf = 1 + ln(N / df) / ln(RARE), at most 2.
2. Each text's weighted set (term count times idf) gives SAMPLES consistent weighted samples, and its plain set as many
   of equal weights (term counts and idf may keep the first kind apart where plain similarity is high); each ROWS
   samples of a kind are a band.  Equal texts are one text from here on.
3. Texts that share a band are candidates.  In each bucket, first every text meets the bucket's centre, the text with
   the most company in all of its buckets.  Then buckets that still hold several classes are gone through in blocks,
   where every text meets those of other classes, the most similar samples first, until they are one class.  No pair
   within a class is made, and pairs between classes never leave their block, so a group of copies costs about its
   size in rows.
4. A candidate pair is linked if the weighted Jaccard similarity of the whole texts, or the same with equal weights,
   is at least 0.8.  Classes are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import array_slices, arrow_batches, clear_of, frame, materialize, mix64, quoted, record_batch, release_memory, shingle_hashes, table, text_key, text_or_empty, text_slices
from terralith.llm.components import components, relabel

THRESHOLD = 0.8
SAMPLES, ROWS = 42, 3
#: Shingles in fewer than one of RARE documents share the largest idf.
RARE = 512
#: A shingle is looked into if it is in SHARE / RARE of the rows of some block.
SHARE = 0.75
#: Pairs of which fewer samples of both kinds agree are not verified (at weighted or plain similarity 0.8, 33.6 of 42 of
#: that kind agree on average, deviation 2.6).
AGREE = 22
#: Members of a bucket are compared in blocks of about this many, one of them with so many others at once.
BLOCK, AT_ONCE = 512, 64
#: Or fewer members, so that a block has about this many bytes of text.
BLOCK_BYTES = 1 << 23
#: A task looks for frequent shingles in blocks of about this many shingles; what it finds is sent by hash range, in
#: SLABS ranges or one for each SLAB_ROWS rows.
SLABS, SLAB_ROWS = 64, 1 << 16
COUNTED = 1 << 21
_LAST = (1 << 63) - 1


# --- shingle weights --------------------------------------------------------------------------------


def _distinct(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [np.unique(s, return_counts=True) for s in shingle_hashes(texts)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for part in text_slices(batches, limit=1 << 19):
        yield [np.unique(s) for s in shingle_hashes(part.column("_text").to_pylist())]


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in at least max(2, N / RARE) of the N rows of docs (_text), and their idf.  At
    most RARE times the mean number of shingles of a text."""
    spark = docs.sparkSession
    n = docs.count()
    empty = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    if not n:
        return empty

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def emit(upto: int) -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(held[:upto]), return_counts=True)
            often = count >= upto * SHARE / RARE
            del held[:upto], sizes[:upto]
            h, count = h[often], count[often]
            ends = np.searchsorted(h, edges).tolist()
            parts = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(h)])) if b > a]
            return record_batch(slab=pa.array([k for k, _, _ in parts], pa.int64()), h=pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary()), n=pa.array([count[a:b].astype(np.int64).tobytes() for _, a, b in parts], pa.binary()))

        for found in _sets(batches):
            held += found
            sizes += map(len, found)
            # a block is closed only when as much again is there: the last block of a task is no small rest, in which
            # every shingle would be frequent
            if sum(sizes) >= 2 * COUNTED:
                yield emit(max(1, int(np.searchsorted(np.cumsum(sizes), COUNTED))))
        if held:
            yield emit(len(held))

    def summed(slab: pd.DataFrame) -> pd.DataFrame:
        h, at = np.unique(np.frombuffer(b"".join(slab["h"]), np.uint64), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(slab["n"]), np.int64)).astype(np.int64)
        return frame(h=h[total >= least].view(np.int64), n=total[total >= least])

    # a shingle in N / RARE rows is counted in all blocks but those where it is in fewer than SHARE / RARE of the rows:
    # what is counted of it is at least the rest.  In few rows every shingle is a candidate, and all counts are exact
    slabs, counted_once = max(SLABS, n // SLAB_ROWS), n * SHARE <= RARE
    edges = np.array([(k << 64) // slabs for k in range(1, slabs)], np.uint64)
    least = max(2.0, n / RARE) if counted_once else n * (1 - SHARE) / RARE
    with arrow_batches(spark):
        lower = docs.mapInArrow(candidates, "slab long, h binary, n binary").groupBy("slab").applyInPandas(summed, "h long, n long").toPandas()
    if counted_once:
        rows = lower
    else:
        asked = np.sort(lower["h"].to_numpy().view(np.uint64))
        shared = spark.sparkContext.broadcast(asked)

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(shared.value), np.int64)
            for found in _sets(batches):
                if len(counts) and (joined := np.concatenate(found)).size:
                    at = np.minimum(np.searchsorted(shared.value, joined), len(counts) - 1)
                    counts += np.bincount(at[shared.value[at] == joined], minlength=len(counts))
            there = np.flatnonzero(counts)
            yield record_batch(h=shared.value[there].view(np.int64), n=counts[there])

        with arrow_batches(spark):
            rows = docs.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2.0, n / RARE)).toPandas()
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    idf = 1 + np.log(n / rows["n"].to_numpy().astype(np.float64)) / np.log(RARE)
    return h[order], np.clip(idf[order], 1, 2).astype(np.float32)


def weights(h: np.ndarray, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, idf = frequent
    out = np.full(len(h), 2.0, np.float32)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        out = np.where(known[at] == h, idf[at], out)
    return out * counts.astype(np.float32)


# --- consistent weighted samples --------------------------------------------------------------------


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 at the middles of n equal shares: 1 - (1 + x) exp(-x) = q."""
    q = (np.arange(n) + 0.5) / n
    x = np.full(n, 1.0)
    for _ in range(60):
        step = (1 - (1 + x) * np.exp(-x) - q) / (x * np.exp(-x))
        x = np.clip(x - step, x / 4, x * 4)
    return x


_R = _gamma_quantiles(1 << 12).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_KEYS, _PLAIN_KEYS = ([mix64(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1) for k in range(a, a + SAMPLES)] for a in (0, SAMPLES))


def weighted_samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) 64-bit samples.  h and weight: the texts' shingles one text after another, each text having
    at least one; starts: where each text begins.

    For shingle k with weight S and sample j: r, c ~ Gamma(2, 1) and b ~ U(0, 1) by hash of (k, j);
    t = floor(ln S / r + b); the shingle with the least ln c - r (t - b + 1) is taken, with its t.
    """
    log_s = np.log(weight)
    out = np.empty((len(starts), SAMPLES), np.uint64)
    lengths = np.diff(np.append(starts, len(h)))
    for j, key in enumerate(_KEYS):
        z = h * key
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(29)
        r = _R[(z & np.uint64(4095)).astype(np.intp)]
        c = _LOG_C[((z >> np.uint64(12)) & np.uint64(65535)).astype(np.intp)]
        b = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_s / r + b)
        a = c - r * (t - b + 1)
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, lengths))
        hit = hit[np.searchsorted(hit, starts)]
        out[:, j] = mix64(h[hit] + (t[hit].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out


def plain_samples(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same with equal weights, where the sampling comes down to the shingle of the least hash."""
    out = np.empty((len(starts), SAMPLES), np.uint64)
    for j, key in enumerate(_PLAIN_KEYS):
        z = h * key
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(29)
        out[:, j] = mix64(np.minimum.reduceat(z, starts))
    return out


def signed(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (doc_id, text_key, _text) as (doc_id, text_key, bands array<long>, samples binary): 16 bits of each
    sample, the weighted ones first.  A text without words has neither."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    n = 2 * SAMPLES // ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=1 << 19):
            sets = _distinct(part.column("_text").to_pylist())
            full = [i for i, (h, _) in enumerate(sets) if len(h)]
            keys, samples = np.zeros((len(full), n), np.uint64), [b""] * len(sets)
            if full:
                h = np.concatenate([sets[i][0] for i in full])
                w = weights(h, np.concatenate([sets[i][1] for i in full]), shared.value)
                sizes = np.array([len(sets[i][0]) for i in full])
                starts = np.cumsum(sizes) - sizes
                found = np.concatenate([weighted_samples(h, w, starts), plain_samples(h, starts)], axis=1)
                for k in range(ROWS):
                    keys = mix64(keys + found[:, k::ROWS] + np.uint64(k))
                keys = mix64(keys + np.arange(n, dtype=np.uint64))
                short = found.astype(np.uint16)
                for row, i in enumerate(full):
                    samples[i] = short[row].tobytes()
            ends = np.cumsum([n if len(h) else 0 for h, _ in sets], dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[np.int32(0)], ends])), pa.array(keys.view(np.int64).ravel()))
            yield record_batch(doc_id=part.column("doc_id"), text_key=part.column("text_key"), bands=bands, samples=pa.array(samples, pa.binary()))

    return docs.select("doc_id", "text_key", "_text").mapInArrow(sign, "doc_id long, text_key string, bands array<long>, samples binary")


# --- candidates -------------------------------------------------------------------------------------


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member (bucket, tid) with the centre of its bucket: distinct (a, b).  The centre is the text with the
    most company in all of its buckets, of equal ones the least."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("bucket").alias("_bucket"), "_n")
    shared = materialize(members.join(sizes, F.col("bucket") == F.col("_bucket")).select("bucket", "tid", "_n"))
    company = shared.groupBy("tid").agg(F.sum("_n").alias("_company")).withColumnRenamed("tid", "_tid")
    ranked = materialize(shared.join(company, F.col("tid") == F.col("_tid")).select("bucket", "tid", F.struct(F.col("_company"), (-F.col("tid")).alias("_minus")).alias("_rank")))
    centres = materialize(ranked.groupBy("bucket").agg(F.max("_rank").alias("_top")).select(F.col("bucket").alias("_bucket"), (-F.col("_top._minus")).alias("b")))
    pairs = ranked.join(centres, F.col("bucket") == F.col("_bucket")).filter(F.col("tid") != F.col("b")).select(F.col("tid").alias("a"), "b")
    return pairs.distinct()


def _similar(h: np.ndarray, w: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The greater of weighted and plain Jaccard similarity of a set (sorted hashes, weights) with each other set."""
    sizes = np.array([len(g) for g, _ in others])
    starts = np.cumsum(sizes) - sizes
    g, v = np.concatenate([x for x, _ in others]), np.concatenate([x for _, x in others]).astype(np.float64)
    at = np.minimum(np.searchsorted(h, g), len(h) - 1)
    common = h[at] == g
    least = np.add.reduceat(np.where(common, np.minimum(w[at].astype(np.float64), v), 0.0), starts)
    both = np.add.reduceat(common.astype(np.int64), starts)
    total = w.astype(np.float64).sum() + np.add.reduceat(v, starts)
    return np.maximum(least / (total - least), both / (len(h) + sizes - both))


class _Classes:
    """Union-find over the class numbers of one cell."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _weighted_sets(texts: pa.Array, frequent: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and weights of each text, of which only a slice becomes strings at once."""
    return [(h, weights(h, n, frequent)) for part in array_slices(texts, 1 << 19) for h, n in _distinct(texts[part].to_pylist())]


def _cell_links(band: int, same: bool, members: list, frequent: tuple[np.ndarray, np.ndarray], threshold: float, texts: pa.Array | None = None) -> list[tuple[int, int]]:
    """Links between classes among a cell's members (left, tid, class, samples, and _text unless their texts are given
    apart): for each left one the right ones of other classes, the most similar samples first, until the classes are
    one.  A pair is looked at in the first band that it shares only; in a cell of one block, once."""
    if not same and len({m["left"] for m in members}) < 2:  # one of the two blocks is empty
        return []
    sets = _weighted_sets(pa.array([m["_text"] for m in members]) if texts is None else texts, frequent)
    order = sorted(range(len(members)), key=lambda i: members[i]["tid"])
    members, sets = [members[i] for i in order], [sets[i] for i in order]
    samples = np.frombuffer(b"".join(bytes(m["samples"]) for m in members), np.uint16).reshape(len(members), 2 * SAMPLES)
    left = [i for i, m in enumerate(members) if m["left"]]
    right = np.array([i for i, m in enumerate(members) if same or not m["left"]], np.int64)
    classes, links = _Classes(), []
    for i in left:
        equal = samples[right] == samples[i]
        bands = equal.reshape(len(right), 2 * SAMPLES // ROWS, ROWS).all(axis=2)
        agree = equal.reshape(len(right), 2, SAMPLES).sum(axis=2).max(axis=1)
        ok = (agree >= AGREE) & bands.any(axis=1) & (bands.argmax(axis=1) == band)
        if same:
            ok &= right > i
        asked = right[ok][np.argsort(-agree[ok], kind="stable")].tolist()
        while asked:
            mine = classes.find(members[i]["class"])
            asked = [j for j in asked if classes.find(members[j]["class"]) != mine]
            part, asked = asked[:AT_ONCE], asked[AT_ONCE:]
            if part:
                for j, s in zip(part, _similar(*sets[i], [sets[j] for j in part])):
                    if s >= threshold and classes.join(members[i]["class"], members[j]["class"]):
                        links.append((members[i]["tid"], members[j]["tid"]))
    return links


def cross_links(members: DataFrame, texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """Links (a, b) that join different classes, from members (bucket, band, tid, class, samples, bytes) and texts
    (tid, _text).

    Buckets of one class are left out.  A bucket's largest class and the rest are dealt into blocks of about BLOCK
    members or BLOCK_BYTES of text each.  A cell is two blocks of the rest, or one of the rest and one of the largest class, so no task holds
    more than two blocks, and members of the largest class are sent as often as the rest has blocks.  All pairs of
    different classes of which AGREE samples of a kind agree are held against each other within their cell; what leaves it are
    the links that join classes, fewer than the cell has members.
    """
    # a member counts as a BLOCK-th of a block, or as the share of BLOCK_BYTES that its text has
    sizes = members.groupBy("bucket", "class").agg(F.sum(F.greatest(F.lit(1.0), F.col("bytes") * (BLOCK / BLOCK_BYTES))).alias("_n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("_classes"), F.max_by("class", F.struct("_n", "class")).alias("_largest"), F.max("_n").alias("_most"), F.sum("_n").alias("_all")).filter("_classes > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK).cast("int"))
    mixed = materialize(mixed.select(F.col("bucket").alias("_bucket"), "_largest", blocks(F.col("_most")).alias("_b"), blocks(F.col("_all") - F.col("_most")).alias("_r")))
    rows = members.join(mixed, F.col("bucket") == F.col("_bucket")).withColumn("_in", F.col("class") == F.col("_largest"))
    rows = rows.join(texts.select(F.col("tid").alias("_t"), "_text"), F.col("tid") == F.col("_t"))
    own = F.pmod(F.xxhash64("tid"), F.when(F.col("_in"), F.col("_b")).otherwise(F.col("_r"))).cast("int")
    rows = rows.withColumn("_own", own)

    def cell(rest: Column, i: Column, j: Column, left: Column) -> Column:
        return F.struct(rest.alias("rest"), i.alias("i"), j.alias("j"), left.alias("left"))

    mine, yes, no = F.col("_own"), F.lit(True), F.lit(False)
    among = F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda k: cell(yes, F.least(mine, k), F.greatest(mine, k), mine <= k))
    against = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda k: cell(no, mine, k, yes))
    asked = F.transform(F.sequence(F.lit(0), F.col("_r") - 1), lambda k: cell(no, k, mine, no))
    rows = rows.withColumn("_cell", F.explode(F.when(F.col("_in"), asked).otherwise(F.concat(among, against))))
    member = F.struct(F.col("_cell.left").alias("left"), "tid", "class", "samples", "_text")
    cells = rows.groupBy("bucket", "band", "_cell.rest", "_cell.i", "_cell.j").agg(F.collect_list(member).alias("members"))
    shared = members.sparkSession.sparkContext.broadcast(frequent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # of one cell at a time all but the texts becomes Python objects
                cell = batch.column("members")[k].values
                small = [cell.field(c).to_pylist() for c in ("left", "tid", "class", "samples")]
                members = [dict(zip(("left", "tid", "class", "samples"), m)) for m in zip(*small)]
                links = _cell_links(batch.column("band")[k].as_py(), batch.column("same")[k].as_py(), members, shared.value, threshold, cell.field("_text"))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
        release_memory()

    return cells.select("band", (F.col("rest") & (F.col("i") == F.col("j"))).alias("same"), "members").mapInArrow(compare, "a long, b long")


# --- verification -----------------------------------------------------------------------------------


def similarities(one: str, other: str, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted Jaccard similarity of two texts' TF-IDF shingles, and the Jaccard similarity of their sets."""
    (h, n), (g, m) = _distinct([one, other])
    if not len(h) or not len(g):
        return 0.0, 0.0
    v, w = weights(h, n, frequent).astype(np.float64), weights(g, m, frequent).astype(np.float64)
    common, at, to = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    least = np.minimum(v[at], w[to]).sum()
    return float(least / (v.sum() + w.sum() - least)), len(common) / (len(h) + len(g) - len(common))


def verified(pairs: DataFrame, texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """Pairs (a, b) that are linked, with both similarities.  texts (tid, _text)."""
    shared = pairs.sparkSession.sparkContext.broadcast(frequent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_x", 1 << 18):
            found = [similarities(x.as_py(), y.as_py(), shared.value) for x, y in zip(part.column("_x"), part.column("_y"))]
            yield record_batch(a=part.column("a"), b=part.column("b"), similarity=pa.array([f[0] for f in found], pa.float64()), plain=pa.array([f[1] for f in found], pa.float64()))

    both = pairs.join(texts.select(F.col("tid").alias("_s"), F.col("_text").alias("_x")), F.col("a") == F.col("_s"))
    both = both.join(texts.select(F.col("tid").alias("_t"), F.col("_text").alias("_y")), F.col("b") == F.col("_t")).select("a", "b", "_x", "_y")
    linked = both.mapInArrow(compare, "a long, b long, similarity double, plain double")
    return linked.filter(F.greatest("similarity", "plain") >= threshold)


# --- classes ----------------------------------------------------------------------------------------


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_key, root (a number of the class), class_id, the least doc_id of
    the class (null if it has none), and n_class, its number of rows.

    Null and empty texts are one class, equal texts always share one.  Texts of one to four words have one shingle.
    Repeated rows each count.  An empty table gives no rows.  Other columns are ignored.
    """
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_or_empty().alias("_text"))
    frequent = frequent_shingles(full.select("_text"))
    rows = materialize(signed(full, frequent))
    first = rows.groupBy("text_key").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("least_id"), F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.count("*").alias("n"))
    texts = materialize(first.withColumn("tid", F.monotonically_increasing_id()))
    members = materialize(texts.select("tid", F.posexplode("bands").alias("band", "bucket")))

    sizes = members.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("bucket").alias("_bucket"))
    members = materialize(members.join(sizes, F.col("bucket") == F.col("_bucket")).select("bucket", "band", "tid"))
    needed = texts.join(members.select(F.col("tid").alias("_tid")).distinct(), F.col("tid") == F.col("_tid"))
    needed = materialize(needed.select("tid", F.col("text_key").alias("_key"), "least_id"))
    # a text is fetched from the row with its least id, from one of them if it is repeated: repeated rows go first, so
    # that texts are dealt out once
    own = full.select("_text", "text_key", F.coalesce("doc_id", F.lit(_LAST)).alias("_id")).dropDuplicates(["text_key", "_id"])
    fetched = own.join(needed, (F.col("text_key") == F.col("_key")) & (F.col("_id") == F.col("least_id"))).select("tid", "_text")
    fetched = materialize(fetched.withColumn("bytes", F.octet_length("_text")))

    pairs = materialize(star_pairs(members.select("bucket", "tid")))
    labels = components(materialize(verified(pairs, fetched, frequent, threshold).select("a", "b")))
    known = texts.select(F.col("tid").alias("_tid"), "samples")
    known = known.join(fetched.select(F.col("tid").alias("_t"), "bytes"), F.col("_tid") == F.col("_t")).drop("_t")
    held = relabel(members.withColumn("class", F.col("tid")), labels, "class").join(known, F.col("tid") == F.col("_tid"))
    links = materialize(cross_links(materialize(held.drop("_tid")), fetched.select("tid", "_text"), frequent, threshold))
    if not links.isEmpty():
        joined = components(relabel(relabel(links, labels, "a"), labels, "b"))
        # classes that were single texts so far enter the table too
        single = joined.join(labels.select(F.col("node").alias("_old")), F.col("node") == F.col("_old"), "left_anti")
        labels = materialize(relabel(labels, joined, "label").unionByName(single))

    rooted = relabel(texts.select("text_key", "least_id", "n", F.col("tid").alias("root")), labels, "root")
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("_class"), F.sum("n").alias("n_class")).withColumnRenamed("root", "_root")
    rooted = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("text_key").alias("_key"), "root", "_class", "n_class")
    out = rows.select("doc_id", "text_key").join(materialize(rooted), F.col("text_key") == F.col("_key"))
    return out.select("doc_id", "text_key", "root", F.when(F.col("_class") != _LAST, F.col("_class")).alias("class_id"), "n_class")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one row of each class: the one with the least doc_id (null ids last)."""
    found = materialize(classes(docs, threshold))
    kept = found.filter(F.coalesce("doc_id", F.lit(_LAST)) == F.coalesce("class_id", F.lit(_LAST)))
    own = {c: clear_of(c, docs.columns) for c in ("own_id", "own_key", "id", "key")}
    one = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias(own["id"]), F.col("text_key").alias(own["key"]))
    kept = kept.groupBy("root").agg(F.min_by(one, "text_key").alias("_one")).select("_one.*")
    # a class has one text here and one id; rows that repeat both go before the join, so that texts are dealt out once
    joined = docs.withColumn(own["own_id"], F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(own["own_key"], text_key())
    joined = joined.dropDuplicates([own["own_key"], own["own_id"]])
    joined = joined.join(kept, (F.col(own["own_key"]) == F.col(own["key"])) & (F.col(own["own_id"]) == F.col(own["id"])))
    return joined.select(*map(quoted, docs.columns))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")
