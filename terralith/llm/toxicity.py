"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is, and only documents are labelled.

A sentence's score is logistic in the sum of its features' weights; a document's is the noisy-or of its sentences,
1 - prod(1 - p).  Weights maximise the likelihood of the documents' labels, so the sentences of a toxic document share the
blame by their own scores, and the trained model points at the offending ones.

Features are hashed: words, their beginnings of 4 to 6 letters (a stem with any ending), and pairs of neighbouring words.
A feature counts by how clearly the labels of the documents that hold it differ from the others' (the root of their
log-likelihood ratio), so that few labelled documents are enough to tell an offending word from one that is there by chance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import array_slices, chunks_of, class_sample, clear_of, id_bucket, materialize, mix64, quoted, record_batch, run_hashes, segments, table, text_or_empty, text_slices

#: Features are hashed into this many places.
PLACES = 1 << 18
#: The model is fitted on at most so many distinct labelled texts and about so many bytes, half of each class (see
#: common.class_sample), and on LEAST texts of a class at least, where it has them.
SAMPLE, SAMPLE_BYTES, LEAST = 3000, 1 << 24, 20
#: Features of fewer texts of the sample have no weight; one of this evidence counts once.
LEAST_TEXTS, EVIDENT = 3, 4.0
#: A sentence ends after these, before white space or the end; at a line's end; and after so many words.
STOPS, MOST_WORDS = ".!?…。！？", 64
STEMS = range(4, 7)
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.3, 1e-4
THRESHOLD = 0.3
#: A sentence with at least this score offends.
OFFENDS = 0.3
_MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(10)]


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point of the basic plane its lower-cased letter or digit, 0 for white space, else 1."""
    out = np.ones(1 << 16, np.uint32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
        elif c.isspace():
            out[cp] = 0
    return out


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences that hold a word: the number of the text, start and end in code points of it; and of all
    features of all sentences: place, and number of the sentence."""
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    folded = np.where(cp < 1 << 16, _folded()[np.minimum(cp, (1 << 16) - 1)], cp)
    start, end = segments(folded, folded > 1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    blank = folded == 0
    stops = np.isin(cp, np.frombuffer(STOPS.encode("utf-32-le"), np.uint32)) & np.concatenate([blank[1:], [True]])
    breaks = np.flatnonzero(stops | (cp == 10) | (cp == 13))
    between = np.searchsorted(breaks, start)  # the line's end after a text is a break too
    first = np.concatenate([[True], between[1:] != between[:-1]])
    run = np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))
    first |= (np.arange(len(start)) - run) % MOST_WORDS == 0
    sentence = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    tails = np.concatenate([heads[1:], [len(start)]]) - 1
    owner = np.searchsorted(begins, start[heads], "right") - 1

    whole = run_hashes(folded, start, end)
    places, of = [whole * _MIX[0]], [sentence]
    for k in STEMS:
        long = np.flatnonzero(end - start >= k)
        places.append(run_hashes(folded, start[long], start[long] + k) * _MIX[k])
        of.append(sentence[long])
    pair = np.flatnonzero(sentence[1:] == sentence[:-1])
    places.append(mix64(whole[pair] * _MIX[8] + whole[pair + 1]))
    of.append(sentence[pair])
    place = (np.concatenate(places) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    both = np.unique(np.concatenate(of) * PLACES + place)  # a feature counts once a sentence
    return owner, start[heads] - begins[owner], end[tails] - begins[owner], (both % PLACES).astype(np.int32), both // PLACES


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Root of the log-likelihood ratio between a feature's share of toxic and of clean texts being different and being
    the same; toxic and clean are the numbers of texts that hold it."""
    both = (toxic + clean) / max(n_toxic + n_clean, 1)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        miss = n - k
        return k * np.log(np.maximum(k, 1) / np.maximum(n * both, 1e-12)) + miss * np.log(np.maximum(miss, 1e-12) / np.maximum(n * (1 - both), 1e-12))

    return np.sqrt(np.maximum(2 * (part(toxic, n_toxic) + part(clean, n_clean)), 0.0))


class Model:
    """A weight a place and the bias; without weights every sentence has the score of the bias."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def measure(self, texts: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Score of each text, and of all sentences text, start, end and score.  A text without words has score 0."""
        scores, parts = np.zeros(len(texts)), []
        for part in chunks_of(texts, 1 << 18):
            owner, start, end, place, of = sentences(texts[part])
            z = self.bias + np.bincount(of, self.weights[place], len(owner))
            # 1 - prod(1 - p), each 1 - p being 1 / (1 + exp z)
            scores[part] = -np.expm1(-np.bincount(owner, np.logaddexp(0.0, z), part.stop - part.start))
            parts.append((owner + part.start, start, end, 1.0 / (1.0 + np.exp(-z))))
        columns = tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return scores, columns


def fit(texts: list[str], y: np.ndarray, shares: np.ndarray, seed: int = 11) -> Model:
    """The model of greatest likelihood, by stochastic gradient steps of a size that falls feature by feature.

    y: 1 for toxic texts; shares: how many labelled documents there are of class 0 and 1, for texts are weighed as if
    their classes had these shares.  Without words or without both classes there are no weights, only a bias.
    """
    y = np.asarray(y, float)
    rate = float((shares[1] + 0.5) / (shares.sum() + 1.0))
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order]
    owners, places, ofs, at = [], [], [], 0
    for part in chunks_of(texts, 1 << 20):
        owner, _, _, place, of = sentences(texts[part])
        owners.append(owner + part.start)
        places.append(place)
        ofs.append(of + at)
        at += len(owner)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    if not len(owner) or len(set(y[owner])) < 2:
        return Model(np.zeros(PLACES, np.float32), float(np.log(rate / (1 - rate))) if not len(owner) or y.all() else -20.0)
    place, of = np.concatenate(places), np.concatenate(ofs)
    del places, ofs
    class_size = np.array([(y < 1).sum(), (y > 0).sum()])
    seen = np.unique(owner[of] * PLACES + place)
    bad = y[seen // PLACES] > 0
    clean, toxic = (np.bincount(seen[bad == k] % PLACES, minlength=PLACES) for k in (False, True))
    scale = np.where(clean + toxic >= LEAST_TEXTS, evidence(toxic, clean, class_size[1], class_size[0]) / EVIDENT, 0.0)
    used = scale[place] > 0
    place, of = place[used], of[used]

    weight = np.where(y > 0, shares[1] / class_size[1], shares[0] / class_size[0])
    weight *= len(y) / weight.sum()
    w, b = np.zeros(PLACES), float(np.log(rate * len(texts) / len(owner)))
    past, past_b = np.full(PLACES, 1e-6), 1e-6
    first_sentence = np.searchsorted(owner, np.arange(0, len(texts) + BATCH, BATCH))
    first_feature = np.searchsorted(of, first_sentence)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(seed + epoch).permutation(len(first_sentence) - 1):
            s, t = first_sentence[k], first_sentence[k + 1]
            if s == t:
                continue
            mine = place[first_feature[k] : first_feature[k + 1]]
            which = of[first_feature[k] : first_feature[k + 1]] - s
            text = owner[s:t] - k * BATCH
            z = b + np.bincount(which, (w * scale)[mine], t - s)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
            none = np.exp(-np.bincount(text, np.logaddexp(0.0, z), BATCH))  # the chance that no sentence is toxic
            blame = none / np.maximum(1.0 - none, 1e-12)
            labels, weights = y[k * BATCH + text], weight[k * BATCH + text]
            down = weights * p * np.where(labels > 0, -blame[text], 1.0)  # the loss's slope by z
            slope = scale * np.bincount(mine, down[which], PLACES) / BATCH + DECAY * w
            past += slope * slope
            w -= RATE * slope / np.sqrt(past)
            slope_b = float(down.sum()) / BATCH
            past_b += slope_b * slope_b
            b -= RATE * slope_b / np.sqrt(past_b)
    return Model((w * scale).astype(np.float32), b)


def train(labelled: DataFrame, texts: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """From labelled (text_hash, text_bytes, toxic), a row for each labelled document, and texts (text), which has their
    texts.  Rows with null toxic are ignored, toxic >= 1 is class 1.  Copies with equal labels are one text of the sample
    and each count in the classes' shares.  The sample's texts meet in one task, which fits the model; its weights
    (4 bytes a place) are all that comes to the driver."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("toxic").isNotNull()).select((F.col("toxic") >= 1).cast("int").alias("label"), F.col("text_hash").alias("order"), F.col("text_bytes").alias("size"))
    rows = materialize(rows.groupBy("label", "order").agg(F.min("size").alias("size"), F.count("*").alias("n")))
    shares = np.zeros(2)
    for label, n in rows.groupBy("label").agg(F.sum("n")).collect():
        shares[label] = n
    if not shares.sum():
        return Model(np.zeros(PLACES, np.float32), 0.0)
    # bounded: `sample` rows and LEAST a class
    chosen = F.broadcast(class_sample(rows, (0, 1), sample, sample_bytes, LEAST))
    held = texts.select(text_or_empty().alias("text")).withColumn("_order", F.xxhash64("text"))
    picked = held.join(chosen, F.col("_order") == F.col("order")).groupBy("label", "order").agg(F.first("text").alias("text"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((o, y, t) for part in text_slices(batches, "text") for o, y, t in zip(part.column("order").to_pylist(), part.column("label").to_pylist(), part.column("text").to_pylist()))
        model = fit([t for _, _, t in found], np.array([y for _, y, _ in found]), shares)
        yield record_batch(weights=[model.weights.tobytes()], bias=[float(model.bias)])

    weights, bias = materialize(picked.select("label", "order", "text").repartition(1).mapInArrow(fitted, "weights binary, bias double")).first()
    return Model(np.frombuffer(weights, np.float32), bias)


def verdict(spark: SparkSession, model: Model, text: str = "text", offends: float = OFFENDS) -> F.Column:
    """A struct for the column `text`: score, n_sentences, and offending, an array of start, end (code points, the end
    excluded) and score of each sentence with at least the score `offends`, in order.  Null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>")
    def of_texts(texts: pa.Array) -> pa.Array:
        out, kinds = [], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for part in array_slices(texts):
            held = texts[part].to_pylist()
            scores, (owner, start, end, p) = shared.value.measure(held)
            bad = np.flatnonzero(p >= offends)
            ends = np.searchsorted(owner[bad], np.arange(len(held) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(start[bad]), pa.array(end[bad]), pa.array(p[bad])], ["start", "end", "score"])
            lists = pa.ListArray.from_arrays(pa.array(ends), spans).cast(kinds)
            out.append(pa.StructArray.from_arrays([pa.array(scores), pa.array(np.bincount(owner, minlength=len(held)).astype(np.int64)), lists], ["score", "n_sentences", "offending"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("score", pa.float64()), ("n_sentences", pa.int64()), ("offending", kinds)]))

    return of_texts(text_or_empty(text))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, offends: float = OFFENDS) -> DataFrame:
    """docs with score (0 to 1, higher: toxic likelier), predicted (1 if score >= threshold, else 0), n_sentences and
    offending (see verdict); columns of these names that docs has are replaced.

    Null text is empty; a text without a word has no sentence and score 0.  Whole texts are read; equal texts have equal
    scores; an empty table stays empty.
    """
    name = clear_of("found", docs.columns)
    added = ("score", "predicted", "n_sentences", "offending")
    found = docs.withColumn(name, verdict(docs.sparkSession, model, offends=offends))
    value = F.col(f"{name}.score")
    return found.select(*(quoted(c) for c in docs.columns if c not in added), value.alias("score"), (value >= threshold).cast("int").alias("predicted"), F.col(f"{name}.n_sentences").alias("n_sentences"), F.col(f"{name}.offending").alias("offending"))


def offending_sentences(docs: DataFrame, model: Model, offends: float = OFFENDS) -> DataFrame:
    """A row for each offending sentence: doc_id, start, end (code points), score and the sentence itself."""
    found = docs.select("doc_id", text_or_empty().alias("_text"), F.explode(verdict(docs.sparkSession, model, offends=offends)["offending"]).alias("_s"))
    at, length = F.col("_s.start"), F.col("_s.end") - F.col("_s.start")
    return found.select("doc_id", at.alias("start"), F.col("_s.end").alias("end"), F.col("_s.score").alias("score"), F.substring("_text", (at + 1).cast("int"), length.cast("int")).alias("sentence"))


def held_out() -> F.Column:
    return id_bucket("doc_id", 4) == 2


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text_bytes, toxic) of the documents that have a label; of several labels of an id the greatest
    holds.  Ids and hashes are joined, not texts."""
    best = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), F.octet_length(text_or_empty()).alias("text_bytes")).join(best, "doc_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = docs.filter(~held_out())
    model = train(with_labels(known, labels.filter(~held_out())), known)
    found = score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    first = F.get("offending", F.lit(0))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"), first["start"].alias("first_start"), first["end"].alias("first_end"))
