"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are lower-cased, everything but letters becomes one space, and four-character grams are counted per language over
all training documents: tasks count their own texts, counts meet by gram.  Each language's model is a sorted array of
the hashes of all its grams with a log probability each, and sorted arrays for the lower orders; a gram that a model lacks
backs off.  Models are files of the shared folder, made one at a time; a task keeps a bounded part of them in memory and
reads the others again.  A text goes to the language with the lowest cross-entropy per character; texts whose
cross-entropy lies above what all labelled texts of that language show, each by a model of the half that it isn't in, are
rejected.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import array_slices, chunks_of, clear_of, id_bucket, least_levels, level_of, materialize, mix64, quoted, record_batch, scratch_dir, table, text_or_empty, text_slices

ORDER = 4
#: None: a language's model lists all its grams.  A number: only so many most frequent ones of each order (and the last
#: parts of listed longer ones); the others are counted like them, and their probability is dealt out by their context's
#: back-off weight.
MAX_GRAMS: int | None = None
#: Bytes of models that a process keeps; what goes beyond is read from its file whenever it is asked.
KEEP = 256 << 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point of the basic plane its lower-cased letter, or a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
    return out


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, one space for each run of others, one space at both ends; letters
    beyond the basic plane are folded into its private area.  Empty if there is no letter."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = cp >= 1 << 16
    if high.any():
        up = np.array([0xE000 + ord(c) % 0x1000 if c.isalpha() else 32 for c in map(chr, cp[high])], np.uint32)
        cp = np.where(high, 0, cp)
        out = _classes()[cp]
        out[high] = up
    else:
        out = _classes()[cp]
    out = np.concatenate([[np.uint32(32)], out, [np.uint32(32)]])
    space = out == 32
    out = out[np.concatenate([[True], ~(space[1:] & space[:-1])])]
    return out if len(out) > 2 else out[:0]


def grams(chars: np.ndarray) -> np.ndarray:
    """Four-character grams as 64-bit numbers, 16 bits a character, the last character lowest.  Two spaces are put
    before the text, so that each of its characters but the first space ends a gram."""
    x = np.concatenate([np.full(2, 32, np.uint64), chars.astype(np.uint64)])
    return (x[:-3] << np.uint64(48)) | (x[1:-2] << np.uint64(32)) | (x[2:-1] << np.uint64(16)) | x[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, half, text) as (lang, half, gram, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 19):
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, half, text in zip(*(part.column(c).to_pylist() for c in ("lang", "half", "text"))):
                if len(c := letters(text)):
                    found.setdefault((lang, half), []).append(grams(c))
            for (lang, half), mine in found.items():
                g, n = np.unique(np.concatenate(mine), return_counts=True)
                yield record_batch(lang=[lang] * len(g), half=np.full(len(g), half), gram=g.view(np.int64), n=n.astype(np.int64))

    counted = docs.select("lang", "half", "text").mapInArrow(count, "lang string, half long, gram long, n long")
    return counted.groupBy("lang", "half", "gram").agg(F.sum("n").alias("n"))


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


@dataclass(frozen=True)
class Level:
    """Sorted grams of one order that a model lists; for each its count, and the total and kinds of all grams with its
    context, listed or not; the discount of all grams of that order."""

    grams: np.ndarray
    counts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    discount: float


def all_levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """The levels that list every gram: keys are a language's sorted four-character grams."""
    by = {ORDER: (keys.astype(np.uint64), counts)}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
        by[k] = tuple(np.unique(by[k + 1][0] & _mask(k), return_counts=True))
    out = {}
    for k, (g, n) in by.items():
        _, at = np.unique(g >> np.uint64(16), return_inverse=True)
        out[k] = Level(g, n, np.bincount(at, n)[at], np.bincount(at)[at], _discount(np.count_nonzero(n == 1), np.count_nonzero(n == 2)))
    return out


def _interpolated(level: Level, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One interpolated Kneser-Ney level: probabilities of the listed grams, and for each distinct context (sorted) of
    one of them its back-off weight.  `lower`: lower-order probability of each gram's last part.

    With weight v = discount * kinds / total, all grams of a context have (n - discount) / total + v * lower.  Those
    that are not listed share what the listed ones leave, in proportion to their lower-order probability, so the
    back-off weight is v and, over the lower-order probability of what is not listed, their discounted counts."""
    n, total, kinds, d = level.counts.astype(np.float64), level.totals.astype(np.float64), level.kinds.astype(np.float64), level.discount
    contexts, first, at, listed = np.unique(level.grams >> np.uint64(16), return_index=True, return_inverse=True, return_counts=True)
    own, v = (n - d) / total, d * kinds / total
    left = np.where(listed < kinds[first], 1.0 - v[first] - np.bincount(at, own, len(contexts)), 0.0)
    weight = v[first] + left / np.where(left > 0, np.maximum(1.0 - np.bincount(at, lower, len(contexts)), 1e-12), 1.0)
    return own + v * lower, contexts, weight


class Model:
    """A language's model: for orders 4, 3, 2 sorted gram hashes with log probabilities and sorted context hashes
    with log back-off weights; log probabilities of single characters; the log probability of any other.

    From all grams (keys and counts), or from levels of which the first lists every character, and each other only
    grams whose last part the level below lists."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None, levels: dict[int, Level] | None = None) -> None:
        by = all_levels(keys, counts) if levels is None else levels
        single, kinds = by[1].grams, by[1].counts.astype(np.float64)
        spread = 1.0 / (len(single) + 1)
        d = 0.5
        rest = d * len(single) / kinds.sum()
        p = (kinds - d) / kinds.sum() + rest * spread
        self.other = np.float32(np.log(rest * spread))
        self.levels = {1: (*_sorted(single, np.log(p)), None, None)}
        before, p_before = single, p
        for k in range(2, ORDER + 1):
            g = by[k].grams
            lower = p_before[np.searchsorted(before, g & _mask(k - 1))]
            p, contexts, weight = _interpolated(by[k], lower)
            self.levels[k] = (*_sorted(g, np.log(p)), *_sorted(contexts, np.log(weight)))
            before, p_before = g, p

    def log_p(self, g: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character after the others."""
        out, left, add = np.empty(len(g), np.float32), np.arange(len(g)), np.zeros(len(g), np.float32)
        for k in range(ORDER, 0, -1):
            part = g[left] & _mask(k)
            hashes, logs, contexts, weights = self.levels[k]
            at, there = _find(hashes, part)
            out[left[there]] = logs[at[there]] + add[left[there]]
            left, part = left[~there], part[~there]
            if not len(left):
                return out
            if k > 1:
                at, there = _find(contexts, part >> np.uint64(16))
                add[left[there]] += weights[at[there]]
        out[left] = self.other + add[left]
        return out


#: Models that this process keeps, by file.
_KEPT: dict[str, Model] = {}


class Stored:
    """A model in a file of the shared folder."""

    def __init__(self, model: Model, folder: str, name: str) -> None:
        self.folder, self.name = folder, name
        arrays = {f"{k}_{i}": a for k, level in model.levels.items() for i, a in enumerate(level) if a is not None}
        self.size = sum(a.nbytes for a in arrays.values())
        held = io.BytesIO()
        np.savez(held, other=model.other, **arrays)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(held.getbuffer())

    def load(self) -> Model:
        path = f"{self.folder}/{self.name}"
        if path in _KEPT:
            return _KEPT[path]
        store, root = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(f"{root}/{self.name}") as f:
            arrays = np.load(io.BytesIO(f.read()))
        model = Model.__new__(Model)
        model.other, model.size = arrays["other"][()], self.size
        model.levels = {k: tuple(arrays[n] if (n := f"{k}_{i}") in arrays else None for i in range(4)) for k in range(1, ORDER + 1)}
        full = lambda: self.size + sum(m.size for m in _KEPT.values()) > KEEP
        if full():  # those of other trainings go first
            for other in [p for p in _KEPT if not p.startswith(f"{self.folder}/")]:
                del _KEPT[other]
        if not full():
            _KEPT[path] = model
        return model

    @property
    def levels(self) -> dict:
        return self.load().levels

    def log_p(self, g: np.ndarray) -> np.ndarray:
        return self.load().log_p(g)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 16 * k) - 1)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = mix64(keys.astype(np.uint64))
    order = np.argsort(hashes)
    return hashes[order], values[order].astype(np.float32)


def _find(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys)
    if not len(hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return at, hashes[at] == h


class Identifier:
    """All languages' models; `limits` has for each language the cross-entropy above which a text is rejected, as
    mean and allowance (an allowance falls with the root of the number of characters down to a floor)."""

    def __init__(self, models: dict[str, Model | Stored], limits: dict[str, tuple[float, float, float]] | None = None) -> None:
        self.names, self.models, self.limits = sorted(models), models, limits or {}

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) nats a character, and the number of characters of each text (0: no letter)."""
        sums, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        for part in chunks_of(texts, 1 << 18):
            found = [grams(c) if len(c) else np.zeros(0, np.uint64) for c in map(letters, texts[part])]
            n = np.array([len(f) for f in found])
            sizes[part] = n
            if not n.sum():
                continue
            distinct, back = np.unique(np.concatenate(found), return_inverse=True)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            for j, name in enumerate(self.names):
                sums[np.arange(part.start, part.stop)[full], j] = -np.add.reduceat(self.models[name].log_p(distinct)[back].astype(np.float64), starts)
        return sums / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected.  score: the share of the best language in a softmax of the
        cross-entropies over at most 50 characters' worth of evidence; halved for rejected texts; 0 without letters."""
        found, sizes = self.cross_entropies(texts)
        out = []
        for h, n in zip(found, sizes):
            if not n or not self.names:
                out.append((UNKNOWN, 0.0, True))
                continue
            j = int(np.argmin(h))
            share = 1.0 / np.exp(-(h - h[j]) * min(int(n), 50)).sum()
            out.append((self.names[j], float(share), self.outside(self.names[j], h[j], n)))
        return [(a, s * (0.5 if r else 1.0), r) for a, s, r in out]

    def outside(self, name: str, h: float, n: int) -> bool:
        if name not in self.limits:
            return False
        mean, spread, floor = self.limits[name]
        return bool(h > mean + max(floor, spread / np.sqrt(n)))


def measured(texts: DataFrame, models: dict[str, Model | Stored]) -> DataFrame:
    """texts (lang, text) as (lang, h, n): each text's cross-entropy by its own language's model, and its characters.
    Written out; texts of languages without a model, and without a letter, are left out."""
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 19):
            mine: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                mine.setdefault(lang, []).append(text)
            for lang in mine.keys() & shared.value.keys():
                h, n = Identifier({lang: shared.value[lang]}).cross_entropies(mine[lang])
                yield record_batch(lang=[lang] * len(n), h=h[:, 0], n=n)

    out = materialize(texts.select("lang", "text").mapInArrow(measure, "lang string, h double, n long").filter("n > 0"))
    shared.destroy()
    return out


def limits_of(known: DataFrame) -> dict[str, tuple[float, float, float]]:
    """From known (lang, h, n) for each language the mean cross-entropy, and allowances above it: five standard deviations
    of the deviation times root length, and at least five deviations of the longer half of the texts; neither below a
    floor, as few texts may agree by chance.  One row a language comes to the driver."""
    means = known.groupBy("lang").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"), F.median("n").alias("median"), F.count("*").alias("texts"))
    square = F.pow(F.col("h") - F.col("mean"), 2)
    found = known.join(F.broadcast(means), "lang").groupBy("lang", "mean", "texts").agg(
        (5 * F.sqrt(F.avg(square * F.col("n")))).alias("spread"), (5 * F.sqrt(F.avg(F.when(F.col("n") >= F.col("median"), square)))).alias("floor")
    )
    return {r["lang"]: (r["mean"], max(r["spread"], 6.0), max(r["floor"], 0.6)) if r["texts"] > 1 else (r["mean"], 6.0, 0.6) for r in found.collect()}


def _levels(counts: DataFrame) -> tuple[DataFrame, dict[tuple[str, int], float]]:
    """From all grams (lang, gram, n): those that the models list (lang, k, gram, n, total, kinds), and the discount of
    each language and order.  Total and kinds are of all grams of the language and order that share the context."""
    out, discounts, rows = None, {}, counts.withColumn("needed", F.lit(False))
    for k in range(ORDER, 0, -1):
        for lang, once, twice in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
            discounts[lang, k] = _discount(once, twice)
        most = F.lit(True)
        if MAX_GRAMS is not None and k > 1:
            least = least_levels(rows, "n", MAX_GRAMS, "lang")
            by = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else F.create_map(F.lit(""), F.lit(0))
            most = level_of("n") >= by[F.col("lang")]
        # a context has no more rows than there are characters
        over = Window.partitionBy("lang", F.shiftrightunsigned("gram", 16))
        rows = rows.withColumn("listed", F.col("needed") | most)
        rows = materialize(rows.withColumn("total", F.sum("n").over(over)).withColumn("kinds", F.count("*").over(over)))
        part = rows.filter("listed").select("lang", F.lit(k).alias("k"), "gram", "n", "total", "kinds")
        out = part if out is None else out.unionByName(part)
        if k > 1:
            last = F.col("gram").bitwiseAND(F.lit(int(_mask(k - 1))))
            rows = materialize(rows.groupBy("lang", last.alias("gram")).agg(F.count("*").alias("n"), F.max("listed").alias("needed")))
    return out, discounts


def models_of(counts: DataFrame) -> dict[str, Stored]:
    """A model of every language in counts (lang, gram, n), each in a file.  The driver holds one language's grams at a
    time."""
    listed, discounts = _levels(counts)
    models, folder = {}, scratch_dir(counts.sparkSession)
    for i, lang in enumerate(sorted({lang for lang, _ in discounts})):
        rows = listed.filter(F.col("lang") == lang).select("k", "gram", "n", "total", "kinds").toPandas()
        levels = {}
        for k in range(1, ORDER + 1):
            part = rows[rows["k"] == k]
            order = np.argsort(part["gram"].to_numpy().view(np.uint64))
            g, n, total, kinds = (part[c].to_numpy()[order] for c in ("gram", "n", "total", "kinds"))
            levels[k] = Level(g.view(np.uint64), n, total, kinds, discounts[lang, k])
        models[lang] = Stored(Model(levels=levels), folder, f"{i}.npz")
    return models


def train(docs: DataFrame) -> Identifier:
    """Models from docs (text, lang; rows with null lang are ignored): all texts are counted.  The limits of rejection
    come from all texts too, each measured by a model of the half of the texts, by a hash, that it isn't in.  A language
    that has texts with a letter in one half only has a model like any other, and no limit.  Null text is
    empty.  An empty table gives models of no language: every text is UNKNOWN then.  The models are scratch files."""
    labelled = docs.filter(F.col("lang").isNotNull()).select("lang", text_or_empty().alias("text"))
    labelled = labelled.filter(F.col("text").rlike(r"\p{L}")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    counts = materialize(gram_counts(labelled))
    known = [measured(labelled.filter(F.col("half") == half), models_of(counts.filter(F.col("half") != half).drop("half"))) for half in (0, 1)]
    models = models_of(materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))))
    return Identifier(models, limits_of(known[0].unionByName(known[1])))


def verdict(spark: SparkSession, model: Identifier, text: str = "text") -> F.Column:
    """A struct of lang_pred, score and rejected for the column `text`; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def language_of(texts: pa.Array) -> pa.Array:
        found = [p for part in array_slices(texts) for p in shared.value.predict(texts[part].to_pylist())]
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds.values())], list(kinds))

    return language_of(text_or_empty(text))


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names that docs has are replaced; `accepted` keeps
    them).

    lang_pred is a learned language, UNKNOWN with score 0 and rejected for texts that are null or have no letter (and
    all texts, if no language was learned).  Ties go to the first language by code point.  Whole texts are read.
    """
    name = clear_of("found", docs.columns)
    found = docs.withColumn(name, verdict(docs.sparkSession, model))
    return found.select(*(quoted(c) for c in docs.columns if c not in ("lang_pred", "score", "rejected")), *(F.col(f"{name}.{c}").alias(c) for c in ("lang_pred", "score", "rejected")))


def accepted(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they are."""
    return docs.filter(~verdict(docs.sparkSession, model)["rejected"])


def held_out() -> F.Column:
    return id_bucket("doc_id", 4) == 2


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
