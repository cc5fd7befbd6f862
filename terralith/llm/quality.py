"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear hinge-loss model fitted
by dual coordinate descent.

Features are hashed n-grams of three kinds: bytes (1 to 4 of the text as it is), word shapes (1 to 3), and
repetitions of the word before.  All labelled training documents take part in each step: the log-count ratios are
theirs; two halves of them have a hinge-loss model each, the mean of what dual coordinate descent finds on its blocks,
weighted by their documents; the logistic curve is fitted on the margins of all documents by the half that they aren't in.
The score is the mean of the two models' margins put through that curve.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import array_slices, chunks_of, class_sample, clear_of, frame, id_bucket, joined_bytes, materialize, mix64, quoted, record_batch, run_hashes, segments, table, text_or_empty, text_slices

#: Features are hashed into this many places; counts are summed in slabs of SLAB places.
PLACES, SLAB = 1 << 18, 1 << 12
#: Bytes of text that one task fits at once; a longer text stands alone.
BLOCK = 1 << 22
#: Only for callers of train() that ask for a sample: the distinct labelled texts, up to half of them of each class, chosen
#: by a hash of the text, and their bytes; but LEAST of each class (the shortest) where that many don't fit.
SAMPLE, SAMPLE_BYTES, LEAST = 2000, 1 << 24, 20
#: Share of such a sample that fits the logistic curve instead.
CALIBRATION = 0.25
THRESHOLD = 0.3
_SEED = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(12)]


@functools.lru_cache(maxsize=1)
def _shapes() -> np.ndarray:
    """Class of each byte: lower-case letter, capital, digit, white space, parts of longer characters, and each mark
    for itself."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 97, 65, 48
    out[[9, 10, 11, 12, 13, 32]] = 32
    out[128:] = 97
    return out


def feature_places(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted distinct places of its features.  An empty text has none."""
    data, at = joined_bytes(texts)
    n = len(data)
    if not n:
        return [np.zeros(0, np.int32) for _ in texts]
    raw, mask = data.astype(np.uint64), np.uint64(PLACES - 1)
    streams = []
    packed = raw.copy()
    for k in range(1, 5):
        if k > 1:
            packed = (packed[:-1] << np.uint64(8)) | raw[k - 1 :]
        streams.append((((packed + np.uint64(1)) * _SEED[k]) >> np.uint64(40), k))
    shape = _shapes()[data]
    start, end = segments(data, shape != 32)
    words = None
    if len(start):
        # a word's shape: its first, second and last class, and its length up to 12
        length = np.minimum(end - start, 12).astype(np.uint64)
        second = shape[np.minimum(start + 1, end - 1)]
        form = (shape[start] << np.uint64(24)) | (second << np.uint64(16)) | (shape[end - 1] << np.uint64(8)) | length
        form = mix64(form)
        whole = run_hashes(data, start, end)
        same = np.concatenate([[False], whole[1:] == whole[:-1]])
        form = np.where(same, np.uint64(0x5EED), form)
        words = np.searchsorted(start, at)
        forms = [form]
        for k in (2, 3):
            forms.append(forms[-1][:-1] * _SEED[8 + k % 2] + form[k - 1 :] if len(forms[-1]) > 1 else forms[-1][:0])
        forms = [(mix64(f + np.uint64(k)) >> np.uint64(40)) for k, f in enumerate(forms)]
    mark = np.zeros(PLACES, bool)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1]) - 1
        for places, k in streams:
            if b - a >= k:
                mark[places[a : b - k + 1] & mask] = True
        if words is not None:
            u, v = int(words[i]), int(words[i + 1])
            for k, f in enumerate(forms):
                if v - u > k:
                    mark[f[u : v - k] & mask] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        out.append(found.astype(np.int32))
    return out


def _count_and_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, label, sampled): slabs of counts per class, and the places of sampled documents."""
    counts, docs, seen = np.zeros((2, PLACES), np.int64), np.zeros(2, np.int64), set()

    def rows(slab: list[int], label: list[int], n: list[int], data: list[bytes]) -> pa.RecordBatch:
        return record_batch(slab=pa.array(slab, pa.int32()), label=pa.array(label, pa.int32()), n=pa.array(n, pa.int64()), data=pa.array(data, pa.binary()))

    for part in text_slices(batches, "text", 1 << 18):
        kept = []
        for label, chosen, places in zip(part.column("label").to_pylist(), part.column("sampled").to_pylist(), feature_places(part.column("text").to_pylist())):
            counts[label][places] += 1
            docs[label] += 1
            if chosen >= 0 and (label, chosen) not in seen:
                seen.add((label, chosen))
                kept.append((label, chosen, places.tobytes()))
        if kept:
            yield rows([-1] * len(kept), *map(list, zip(*kept)))
    for label in (0, 1):
        if docs[label]:
            slabs = np.flatnonzero(counts[label].reshape(-1, SLAB).any(axis=1)).tolist()
            yield rows([*slabs, -2], [label] * (len(slabs) + 1), [0] * len(slabs) + [int(docs[label])], [counts[label][s * SLAB : (s + 1) * SLAB].tobytes() for s in slabs] + [b""])


_PART = "slab int, label int, n long, data binary"


def _sum_slab(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLAB, np.int64)
    for x in rows["data"]:
        total += np.frombuffer(x, np.int64)
    return frame(slab=[int(rows["slab"].iloc[0])], label=[int(rows["label"].iloc[0])], data=[total.tobytes()])


class Classifier:
    """weights by place, bias and the logistic curve; without both classes in training a constant score."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, places: list[np.ndarray]) -> np.ndarray:
        """w.x + b, x being scaled to length 1 (so that long texts have no larger margins)."""
        if self.weights is None:
            return np.zeros(len(places))
        return np.array([float(self.weights[0][p].sum() / np.sqrt(max(self.weights[1][p].sum(), 1e-9))) if len(p) else 0.0 for p in places]) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for part in chunks_of(texts, 1 << 18):
            out[part] = self.margins(feature_places(texts[part]))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * out + self.shift, -500, 500)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: np.ndarray, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model: one dual variable at a time, in random order.

    rows: places and values of each document; y: +1 or -1; c: the bound of each document's dual variable.  The bias
    is the weight of a constant feature.
    """
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    squares = np.array([float(v @ v) for _, v in rows]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            places, values = rows[i]
            gradient = y[i] * (w[places] @ values + b) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[places] += step * values
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic(margins: np.ndarray, y: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margin to probability of class 1: Newton steps on smoothed targets, rows being
    weighted so that the classes (0, 1) have the given shares."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones(len(y))], 1)
    weight = len(y) * np.where(y > 0, shares[1] / max(good, 1), shares[0] / max(bad, 1))
    theta = np.array([1.0, float(np.log(shares[1] / shares[0]))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-3 * (theta - [1.0, 0.0]))
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(counts: np.ndarray, docs: np.ndarray, sample: list[tuple[int, int, np.ndarray]]) -> Classifier:
    """counts (2, PLACES) and docs (2,) of all labelled documents; sample rows (label, order, places)."""
    if not docs.all():
        return Classifier(None, 0.0, 0.0, float(np.log((docs[1] + 0.5) / (docs[0] + 0.5))))
    ratio = _ratio(counts, docs)
    sample = sorted(sample, key=lambda s: (s[1], s[0], len(s[2])))
    rows, y = [], []
    for label, _, places in sample:
        values = ratio[places]
        rows.append((places, (values / np.sqrt(max(float(values @ values), 1e-9))).astype(np.float32)))
        y.append(1.0 if label else -1.0)
    y = np.array(y)
    part = np.arange(len(y)) % max(2, round(1 / CALIBRATION)) == 0
    if len(set(y[~part])) < 2:
        part[:] = False
    fitted = [r for r, p in zip(rows, part) if not p]
    balance = np.where(y[~part] > 0, 1.0, (y[~part] > 0).sum() / max((y[~part] < 0).sum(), 1))
    w, b = dual_coordinate_descent(fitted, y[~part], PLACES, 10.0 * balance)
    model = Classifier(np.stack([w * ratio, ratio * ratio]).astype(np.float32), float(b), 1.0, 0.0)
    use = part if part.any() and len(set(y[part])) == 2 else np.ones(len(y), bool)
    margins = model.margins([s[2] for s, p in zip(sample, use) if p])
    model.slope, model.shift = logistic(margins, y[use], docs / docs.sum())
    return model


def _ratio(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    share = (counts + 1.0) / (docs[:, None] + 2.0)
    return np.log(share[1] / share[0])


def _slabs(weights: np.ndarray) -> list[bytes]:
    return [weights[at : at + SLAB].tobytes() for at in range(0, PLACES, SLAB)]


def _sum_weights(rows: pd.DataFrame) -> pd.DataFrame:
    total = 0.0
    for x in sorted(rows["data"]):  # the sum's last digits must not hang on the order of arrival
        total = total + np.frombuffer(x)
    return frame(slab=[int(rows["slab"].iloc[0])], half=[int(rows["half"].iloc[0])], data=[total.tobytes()])


def _half_models(kept: DataFrame, ratio: np.ndarray, docs: np.ndarray) -> dict[int, Classifier]:
    """From all of kept (text, label, half) a model of each half: the mean over blocks of about BLOCK bytes of the
    hinge-loss model of their documents, weighted by their number."""
    shared, balance = kept.sparkSession.sparkContext.broadcast(ratio), float(docs[1] / docs[0])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, biases, n = {}, {}, {}
        for part in text_slices(batches, "text", BLOCK):
            rows, texts = {}, part.column("text").to_pylist()
            labels, halves = part.column("label").to_pylist(), part.column("half").to_pylist()
            for piece in chunks_of(texts, 1 << 18):
                for label, half, places in zip(labels[piece], halves[piece], feature_places(texts[piece])):
                    values = shared.value[places]
                    rows.setdefault(half, []).append((label, places, (values / np.sqrt(max(float(values @ values), 1e-9))).astype(np.float32)))
            for half, mine in rows.items():
                y = np.array([1.0 if label else -1.0 for label, _, _ in mine])
                w, b = dual_coordinate_descent([r[1:] for r in mine], y, PLACES, 10.0 * np.where(y > 0, 1.0, balance))
                weights[half] = weights.get(half, 0.0) + len(mine) * w
                biases[half], n[half] = biases.get(half, 0.0) + len(mine) * b, n.get(half, 0) + len(mine)
        for half in n:
            data = [*_slabs(weights[half]), np.array([biases[half], n[half]]).tobytes()]
            yield record_batch(slab=pa.array([*range(len(data) - 1), -1], pa.int32()), half=pa.array([half] * len(data), pa.int32()), data=pa.array(data, pa.binary()))

    schema = "slab int, half int, data binary"
    parts = materialize(kept.select("text", "label", "half").mapInArrow(solve, schema))
    sums = {(r["half"], r["slab"]): np.frombuffer(r["data"]) for r in parts.groupBy("slab", "half").applyInPandas(_sum_weights, schema).collect()}
    models = {}
    for half in sorted({half for half, _ in sums}):
        bias, n = sums[half, -1]
        w = np.concatenate([sums[half, k] for k in range(PLACES // SLAB)]) / n
        models[half] = Classifier(np.stack([w * ratio, ratio * ratio]).astype(np.float32), float(bias / n), 1.0, 0.0)
    return models


def _margins(kept: DataFrame, models: dict[int, Classifier]) -> DataFrame:
    """The label and margin of each row of kept (text, label, half) by the model of the other half, if there is one."""
    shared = kept.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 18):
            places, halves = feature_places(part.column("text").to_pylist()), np.array(part.column("half").to_pylist())
            out = np.zeros(len(places))
            for half in set(halves.tolist()):
                at = np.flatnonzero(halves == half)
                out[at] = shared.value.get(1 - half, shared.value[half]).margins([places[i] for i in at])
            yield record_batch(label=part.column("label"), margin=out)

    return materialize(kept.select("text", "label", "half").mapInArrow(measure, "label int, margin double"))


def _logistic_of_all(found: DataFrame, docs: np.ndarray) -> tuple[float, float]:
    """logistic() of all rows of found (label, margin), a class's share being its share of the rows; one row of sums
    comes to the driver for each step."""
    bad, good = map(float, docs)
    target, m = F.when(F.col("label") == 1, (good + 1) / (good + 2)).otherwise(1 / (bad + 2)), F.col("margin")
    theta = np.array([1.0, float(np.log(good / bad))])
    for _ in range(100):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), m * float(theta[0]) + float(theta[1])))
        rows = found.select(m, target.alias("t"), (1 / (1 + F.exp(-z))).alias("p"))
        curve, off = F.col("p") * (1 - F.col("p")), F.col("t") - F.col("p")
        a, b, c, u, v = rows.agg(F.sum(curve * m * m), F.sum(curve * m), F.sum(curve), F.sum(off * m), F.sum(off)).first()
        step = np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-3 * np.eye(2), np.array([u, v]) - 1e-3 * (theta - [1.0, 0.0]))
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def _counted(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by class and place, and documents by class: at most 2 * PLACES / SLAB rows of SLAB counts."""
    counts, docs = np.zeros((2, PLACES), np.int64), np.zeros(2, np.int64)
    for slab, label, data in parts.filter("slab >= 0").groupBy("slab", "label").applyInPandas(_sum_slab, "slab int, label int, data binary").collect():
        counts[label, slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(data, np.int64)
    for label, total in parts.filter("slab = -2").groupBy("label").agg(F.sum("n")).collect():
        docs[label] = total
    return counts, docs


def _train_on_all(rows: DataFrame) -> Classifier:
    """From all of rows (text, label, order), written once.  Halves go by the text's hash, so that copies share one; where
    a class has no text in one of them there is one model, and the curve is fitted on its own margins."""
    kept = materialize(rows.select("text", "label", F.pmod(F.col("order"), F.lit(2)).cast("int").alias("half")), codec="zstd")
    counts, docs = _counted(materialize(kept.select("text", "label", F.lit(-1).alias("sampled")).mapInArrow(_count_and_sample, _PART)))
    if not docs.all():
        return fit(counts, docs, [])
    if kept.select("label", "half").distinct().count() < 4:
        kept = kept.withColumn("half", F.lit(0))
    ratio = _ratio(counts, docs)
    models = _half_models(kept, ratio, docs)
    slope, shift = _logistic_of_all(_margins(kept, models), docs)
    return Classifier(np.mean([m.weights for m in models.values()], axis=0), float(np.mean([m.bias for m in models.values()])), slope, shift)


def train(labelled: DataFrame, sample: int | None = None, sample_bytes: int | None = None) -> Classifier:
    """From labelled (doc_id, text, quality); rows with null quality are ignored, quality >= 1 is class 1.  Labels of
    repeated rows each count.  Without rows every score is 0.5.  All rows are fitted, unless `sample` or `sample_bytes`
    bound the number and the bytes of the texts that the hinge-loss model is fitted on (see common.class_sample); what
    comes to the driver of them is at most four bytes for each of seven features a byte."""
    rows = labelled.filter(F.col("quality").isNotNull())
    label = (F.col("quality") >= 1).cast("int")
    hashed = F.col("text_hash") if "text_hash" in labelled.columns else F.xxhash64(text_or_empty())
    order = F.shiftrightunsigned(hashed, 2)
    size = F.col("text_bytes") if "text_bytes" in labelled.columns else F.octet_length(text_or_empty())
    rows = rows.select(text_or_empty().alias("text"), label.alias("label"), order.alias("order"), size.alias("size"))
    if sample is None and sample_bytes is None:
        return _train_on_all(rows)
    sample, sample_bytes = SAMPLE if sample is None else sample, SAMPLE_BYTES if sample_bytes is None else sample_bytes
    # copies count once, or a large group of them would fill the sample; at most `sample` and LEAST rows a class
    chosen = class_sample(rows.select("label", "order", "size").distinct(), (0, 1), sample, sample_bytes, LEAST)
    chosen = F.broadcast(chosen.select(F.col("label").alias("_l"), F.col("order").alias("_o")))
    rows = rows.join(chosen, (F.col("label") == F.col("_l")) & (F.col("order") == F.col("_o")), "left").select("text", "label", F.coalesce("_o", F.lit(-1)).alias("sampled"))
    parts = materialize(rows.mapInArrow(_count_and_sample, _PART))
    counts, docs = _counted(parts)
    # about `sample` rows of at most PLACES places
    picked = [(r[0], r[1], np.frombuffer(r[2], np.int32)) for r in parts.filter("slab = -1").select("label", "n", "data").dropDuplicates(["label", "n"]).collect()]
    return fit(counts, docs, picked)


def score_of(spark: SparkSession, model: Classifier, text: str = "text") -> F.Column:
    """The score of the column `text`; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(texts[part].to_pylist()) for part in array_slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text_or_empty(text))


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= threshold, else 0); columns of
    these names that docs has are replaced (`accepted` keeps them).

    Null text is empty; an empty text has the score of the constant feature alone.  Whole texts are read.
    """
    name = clear_of("score", docs.columns)
    kept = [quoted(c) for c in docs.columns if c not in ("score", "predicted")]
    return docs.withColumn(name, score_of(docs.sparkSession, model)).select(*kept, F.col(name).alias("score"), (F.col(name) >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least `threshold`, all columns as they are."""
    return docs.filter(score_of(docs.sparkSession, model) >= threshold)


def held_out() -> F.Column:
    return id_bucket("doc_id", 5) == 0


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash, text_bytes, quality) of the documents that have a label; of several labels of an id the greatest holds.
    Labels grow with the documents, so both sides are dealt out by id at any size."""
    best = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("text_hash"), F.octet_length(text_or_empty()).alias("text_bytes")).join(best.hint("merge"), "doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(with_labels(docs.filter(~held_out()), labels.filter(~held_out())))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
