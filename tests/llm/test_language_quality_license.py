"""Language models, quality classifier, licence rules: held-out accuracy, brute force, odd input."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import language, license_texts, licenses, quality
from terralith.llm.common import table

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", "en"), (3, "12 34 ### 👍", None), (4, "the of and " * 20000, "en"), (4, "the of and " * 20000, "en"), (None, "le la les", "fr")]
ODD_SCHEMA = "doc_id long, text string, lang string"


def test_language_held_out(spark):
    got = language.op7_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and (held["lang_pred"] == held["lang"]).mean() > 0.99
    assert got["rejected"].mean() < 0.02 and got["score"].between(0, 1).all()


def brute_kneser_ney(texts, order=4):
    """Probability of a character after its context by the textbook recursion over dictionaries."""
    padded = ["  " + " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).strip() + " " for t in texts]
    top = Counter(p[i : i + order] for p in padded for i in range(len(p) - order + 1))
    by = {order: top}
    for k in range(order - 1, 0, -1):
        by[k] = Counter(g[1:] for g in by[k + 1])
    spread = 1 / (len(by[1]) + 1)

    def p(g):
        k = len(g)
        if k == 0:
            return spread
        c = by[k]
        if k == 1:
            d, total, kinds = 0.5, sum(c.values()), len(c)
        else:
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            mine = [v for h, v in c.items() if h[:-1] == g[:-1]]
            total, kinds = sum(mine), len(mine)
            if not total:
                return p(g[1:])
        return max(c.get(g, 0) - d, 0) / total + d * kinds / total * p(g[1:]) if c.get(g, 0) else d * kinds / total * p(g[1:])

    return p


def test_model_is_kneser_ney():
    texts = ["the cat sat on the mat and the hat", "a cat and a bat sat"]
    found = np.concatenate([language.grams(language.letters(t)) for t in texts])
    keys, counts = np.unique(found, return_counts=True)
    model, p = language.Model(keys, counts), brute_kneser_ney(texts)
    for g in ["  th", " the", "the ", "cat ", "xat ", "tatt", "zzzz"]:
        packed = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g))], np.uint64)
        assert math.isclose(float(model.log_p(packed)[0]), math.log(p(g)), rel_tol=1e-4), g


def test_small_models_use_all_grams(spark, monkeypatch):
    """Listed grams have the probability of the textbook over all texts, and each context's probabilities add up to 1."""
    texts = [f"the of and to in that number {chr(97 + i % 26)}{chr(97 + i // 26)} of the rat" for i in range(60)] + ["the cat sat on the mat and the hat"]
    found = np.concatenate([language.grams(language.letters(t)) for t in texts])
    keys, n = np.unique(found, return_counts=True)
    counts = spark.createDataFrame([("en", int(g), int(c)) for g, c in zip(keys.view(np.int64), n)], "lang string, gram long, n long")
    full, p = language.models_of(counts)["en"], brute_kneser_ney(texts)
    assert np.allclose(full.log_p(keys), language.Model(keys, n).log_p(keys), atol=1e-5)
    monkeypatch.setattr(language, "MAX_GRAMS", 30)
    model = language.models_of(counts)["en"]
    assert 0 < len(model.levels[4][0]) <= 30 < len(keys)
    listed = keys[language._find(model.levels[4][0], keys)[1]]
    text = lambda g: "".join(chr(int(g) >> 16 * (3 - i) & 0xFFFF) for i in range(4))
    for g, got in zip(listed, model.log_p(listed)):
        assert math.isclose(float(got), math.log(p(text(g))), rel_tol=1e-4), text(g)
    singles = np.unique(keys & np.uint64(0xFFFF))
    for context in np.unique(keys >> np.uint64(16)):
        every = np.append((context << np.uint64(16)) | singles, (context << np.uint64(16)) | np.uint64(0x4E00))
        assert math.isclose(float(np.exp(model.log_p(every).astype(np.float64)).sum()), 1.0, rel_tol=1e-4)


def test_every_language_has_a_model(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_GRAMS", 20)
    rows = [(f"l{i:02d}", f"{chr(0x4E00 + 40 * i + j)}{chr(0x4E01 + 40 * i + j)} " * 3) for i in range(70) for j in range(6)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.names) == 70
    assert [model.predict([t])[0][0] for _, t in rows[5::60]] == [lang for lang, _ in rows[5::60]]


def test_language_odd_rows(spark):
    train = spark.createDataFrame([("en", "the of and to in that " * 5), ("en", "there is the one and another"), ("fr", "le la les des et une " * 5), ("fr", "voici les uns et les autres"), (None, "zzz")], "lang string, text string")
    docs = spark.createDataFrame(ODD, ODD_SCHEMA).withColumn("score", F.lit("clash"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs, language.train(train)).collect()]
    assert [g[1] for g in sorted(got, key=lambda g: (g[0] is None, g[0]))] == ["und", "und", "und", "en", "en", "fr"]
    assert all(0 <= g[2] <= 1 for g in got)
    none = language.identify(docs, language.train(train.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(docs.limit(0), language.train(train)).count() == 0


def test_quality_held_out(spark):
    labels = table(spark, SF, "labels")
    got = quality.op3_quality(spark, SF).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert np.mean([(good > b).mean() for b in bad]) > 0.95
    assert ((got["predicted"] == 1) == (got["score"] >= 0.3)).all()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(200, 5)), np.array([1.0, -2, 0.5, 0, 1])
    y = np.sign(x @ w)
    got, b = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.full(200, 1e4), epochs=2000)
    assert (np.sign(x @ got + b) == y).mean() > 0.98


def test_hinge_objective_is_near_the_best():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = np.where(x[:, 0] + rng.normal(size=60) * 0.5 > 0, 1.0, -1.0)
    w, b = quality.dual_coordinate_descent([(np.arange(3), r) for r in x], y, 3, np.full(60, 1.0), epochs=500)
    value = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:3] + v[3])).sum()
    best, v = np.inf, np.zeros(4)
    for step in range(1, 20000):  # subgradient descent
        active = y * (x @ v[:3] + v[3]) < 1
        grad = v - np.append((y[active, None] * x[active]).sum(0), y[active].sum())
        v = v - grad / step
        best = min(best, value(v))
    assert value(np.append(w, b)) < best * 1.01


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA).withColumn("predicted", F.lit(9))
    rows = [(i, ("clean words here and there number %d" % i) if i % 2 else ("### $$$ %%% " * (i % 7 + 1)), i % 2) for i in range(60)]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    none = quality.train(spark.createDataFrame([], "doc_id long, text string, quality int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    single = quality.train(spark.createDataFrame([(1, "a", 1), (2, None, None)], "doc_id long, text string, quality int"))
    assert all(r["score"] > 0.5 for r in quality.score(docs, single).collect())
    both = quality.with_labels(docs, spark.createDataFrame([(4, 0), (4, 1), (None, 1)], "doc_id long, quality int")).collect()
    assert [r["quality"] for r in both] == [1, 1]


def test_quality_sample_holds_rare_classes_and_copies_once(spark, monkeypatch):
    rows = [(i, "a copy of the same clean text", 1) for i in range(1000)] + [(1000 + i, f"clean words here and there number {i}", 1) for i in range(1000)]
    rows += [(3000 + i, "### $$$ %%% " * (i + 1), 0) for i in range(4)]
    held, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda counts, docs, sample: held.append(sample) or fit(counts, docs, sample))
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"), sample=100)
    labels = [s[0] for s in held[0]]
    assert labels.count(0) == 4 and 20 <= labels.count(1) <= 90 and len({(s[0], s[1]) for s in held[0]}) == len(labels)
    good, bad = model.scores(["clean words here and there number 77", "### $$$ %%% ### $$$ %%% "])
    assert good > 0.5 and bad < good


def brute_base(text):
    words = re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min([h[0] for h in hits], default=None), max([h[0] for h in hits], default=None), ",".join(sorted({h[1] for h in hits}))


def test_licences_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r for r in licenses.op8_licenses(spark, SF).collect()}
    for i, text in zip(docs["doc_id"], docs["text"]):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize(
    "text,labels",
    [
        (None, ""), ("", ""), ("MIT License, mit-license; GENERAL PUBLIC LICENSE", "gpl,mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-4.0"),
        ("SPDX-License-Identifier: Apache-2.0", "apache,apache-2.0"), ("the permit license and smit licenses", ""), ("all rights reserved", "proprietary"),
        ("licenſe mit ĺicense", ""),
    ],
)
def test_licence_labels(text, labels):
    assert licenses.scan_texts([text or ""])["labels"][0] == labels


@pytest.mark.parametrize(
    "text,labels",
    [
        ("licensed under GPL2", "gpl-2"), ("LGPL2.1", "lgpl-2.1"), ("MPL2.0 or Apache2.0", "apache-2.0,mpl-2.0"), ("GPLv2, LGPLv3, MPLv2.0", "gpl-2,lgpl-3,mpl-2.0"),
        ("GPLv 3", "gpl-3"), ("GPL v2.0", "gpl-2.0"), ("SIL Open Font LicenseV1.1", "ofl-1.1"), ("gpl20 gplvx gplv2x", ""), ("MPLv2", "mpl-2"), ("mpl2 1", ""),
    ],
)
def test_licence_versions_without_a_space(text, labels):
    assert licenses.scan_texts([text])["labels"][0] == labels


def test_licence_prefilter_hides_nothing():
    """Each rule's own words, with and without the optional ones and spaces, against all rules without a prefilter."""
    every = [(i, re.compile(f" {r.pattern}(?= )"), r) for i, r in enumerate(licenses.rules())]
    lines = {" ".join(name.split()) + between + version for _, names, versions in licenses.FAMILIES for name in names for version in versions for between in ("", "v", " ", " v", " v ", "v ", " version ", " version", " license", " licence v", " software license")}
    lines |= {re.sub(r"\(\?!.*?\)", "", re.sub(r"\(\?:([^()|]*)[^()]*\)(\{1,8\}|\?)?", r"\1", r.pattern)).replace("\\w+", "x").replace("?", "") for r in licenses.rules()}
    for line in sorted(lines):
        padded = f" {line} "
        hits = [(m.start(), m.end(), i, r) for i, p, r in every for m in p.finditer(padded)]
        starts = licenses._starts(line.split())
        want = [(starts.index(a), starts.index(b), r) for a, b, r in licenses._uncovered(hits)]
        assert licenses.detect(line.split()) == want, line


def test_licence_suppression_and_size():
    rules = licenses.rules()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    words = "licensed under the mit license".split()
    assert [(a, b) for a, b, _ in licenses.detect(words)] == [(0, 5)]
    many = licenses.scan_texts(["mit license " * 30000])
    assert many["n_base"][0] == 30000 and many["last_word"][0] == 59998


def test_licence_odd_rows(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA).withColumn("labels", F.lit(1))
    got = licenses.scan(docs).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and licenses.scan(docs.limit(0)).count() == 0


def an_example(pattern):
    """Words that the pattern matches: first alternatives, optional parts left out."""
    while True:
        shorter = re.sub(r"\(\?!(?:[^()])*\)", "", pattern)
        shorter = re.sub(r"\(\?:[^()]*\)\?", "", shorter)
        shorter = re.sub(r"\(\?:([^()|]*)[^()]*\)(?:\{(\d+),\d+\})?", lambda m: "" if m[2] == "0" else m[1], shorter)
        if shorter == pattern:
            break
        pattern = shorter
    return re.sub(r"\s+", " ", re.sub(r"\[(.)[^\]]*\]", r"\1", pattern).replace("\\w+", "x").replace(" ?", " ").replace("s?", "s").replace("?", "")).strip()


def test_every_signature_has_a_match_and_a_near_miss():
    """Each hand-written signature, a word away from its text, and among unrelated words."""
    seen, total = set(), 0
    for label, lines in license_texts.SIGNATURES.items():
        for pattern in lines.strip().split("\n"):
            assert pattern not in seen, pattern
            seen.add(pattern)
            total += 1
            word, compiled = licenses.needed_word(pattern), re.compile(f" {pattern}(?= )")
            words = an_example(pattern).split()
            assert compiled.search(f" {' '.join(words)} "), (pattern, words)
            assert word in words, (pattern, word)
            missed = [w if w != word else "zzz" for w in words]
            assert not compiled.search(f" {' '.join(missed)} "), pattern
            text = " ".join(["once", "upon", *words, "a", "time"])
            found = {rule.label for _, _, rule in licenses.detect(text.split())}
            assert found, pattern
    assert total >= 250
    assert licenses.detect("once upon a time there was a copy of a book and a notice about its author".split()) == []


def test_prefilter_and_suppression_against_all_rules(spark):
    """Whole documents: all rules without a prefilter, and suppression by comparing every pair of hits."""
    every = [(i, re.compile(f" {r.pattern}(?= )"), r) for i, r in enumerate(licenses.rules())]
    texts = [r["text"] for r in table(spark, SF, "documents").collect() if r["text"] and len(r["text"]) < 20000]
    bodies = [an_example(p) for lines in license_texts.SIGNATURES.values() for p in lines.strip().split("\n")]
    texts += [" and ".join(bodies[k : k + 7]) for k in range(0, len(bodies), 5)]
    for text in texts:
        words = re.findall(licenses.WORD, text.translate(licenses._LOWER))
        line = f" {' '.join(words)} "
        hits = [(m.start(), m.end(), i, r) for i, p, r in every for m in p.finditer(line)]
        better = lambda x, y: (-x[3].priority, x[0] - x[1], x[2]) < (-y[3].priority, y[0] - y[1], y[2])
        # what a suppressed hit would cover is covered by what suppressed it
        want = sorted((a, b, i) for a, b, i, r in hits if not any(better(o, (a, b, i, r)) and o[0] <= a and b <= o[1] for o in hits))
        starts = licenses._starts(words)
        assert [(a, b, r) for a, b, r in licenses.detect(words)] == [(starts.index(a), starts.index(b), licenses.rules()[i]) for a, b, i in want]


def test_every_language_of_one_text_has_a_model(spark):
    """71 languages, 70 of them with a single text: whichever texts the hash holds back, none loses its language."""
    rows = [("l0", f"the of and to in that number {i}") for i in range(60)] + [(f"l{k}", " ".join(chr(0x4E00 + 40 * k + j) for j in range(40))) for k in range(1, 71)]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(model.models) == sorted({r[0] for r in rows})
    assert [p[0] for p in model.predict([t for _, t in rows[60:]])] == [r[0] for r in rows[60:]]


def test_quality_sample_has_long_texts_of_a_rare_class(spark):
    """Texts that each have most of the byte budget: the class keeps texts in the sample, and they score low."""
    rows = [(i, f"clean words here and there number {i} and some more of them", 1) for i in range(40)]
    rows += [(100 + i, ("### $$$ %%% " + f"{i} " * 7) * 20_000, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df, sample_bytes=1 << 16)
    scores = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert max(scores[100 + i] for i in range(3)) < quality.THRESHOLD < min(scores[i] for i in range(40))


def test_all_texts_are_counted_and_set_the_limits(spark):
    """1200 texts: the model is that of all their grams, the limits those of all their cross-entropies by the half without them."""
    rows = [("en", f"the of and to in that number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * (1 + i % 5)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language.train(docs)
    halves = [[r["text"] for r in docs.filter(F.pmod(F.xxhash64("text"), F.lit(2)) == k).collect()] for k in (0, 1)]
    brute = lambda texts: language.Model(*np.unique(np.concatenate([language.grams(language.letters(t)) for t in texts]), return_counts=True))
    keys = np.unique(np.concatenate([language.grams(language.letters(t)) for _, t in rows]))
    assert np.allclose(model.models["en"].log_p(keys), brute([t for _, t in rows]).log_p(keys), atol=1e-5)
    h, n = map(np.concatenate, zip(*(language.Identifier({"en": brute(halves[1 - k])}).cross_entropies(halves[k]) for k in (0, 1))))
    h, mean = h[:, 0], np.average(h[:, 0], weights=n)
    spread, floor = 5 * np.sqrt(np.mean((h - mean) ** 2 * n)), 5 * np.sqrt(np.mean((h - mean)[n >= np.median(n)] ** 2))
    assert len(h) == 1200 and np.allclose(model.limits["en"], (mean, max(spread, 6.0), max(floor, 0.6)))


def test_quality_is_fitted_on_all_labelled_texts(spark, monkeypatch):
    """3000 labelled texts: no sample is drawn, both halves' models and the curve come from every one of them."""
    rows = [(i, f"clean words here and there number {i}" if i % 3 else "### $$$ %%% " * (1 + i % 5) + str(i), int(i % 3 > 0)) for i in range(3000)]
    seen, solve, curve = [], quality._half_models, quality._logistic_of_all
    monkeypatch.setattr(quality, "_half_models", lambda kept, *rest: seen.append(kept.count()) or solve(kept, *rest))
    monkeypatch.setattr(quality, "_logistic_of_all", lambda found, docs: seen.append(found) or curve(found, docs))
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    assert seen[0] == seen[1].count() == 3000
    found = seen[1].toPandas()
    y, docs = np.where(found["label"] == 1, 1.0, -1.0), np.array([1000, 2000])
    assert np.allclose((model.slope, model.shift), quality.logistic(found["margin"].to_numpy(), y, docs / 3000), rtol=1e-4, atol=1e-4)
    good, bad = model.scores(["clean words here and there number 77", "### $$$ %%% ### $$$ %%% "])
    assert bad < quality.THRESHOLD < good


def test_models_list_all_grams(spark, monkeypatch):
    """A language of more than 2^17 grams, most of them seen once: each has the probability of the model of all grams,
    and a process that may keep no model reads them again."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 20000, 2000))) for _ in range(80)] + ["the cat sat on the mat"]
    keys, n = np.unique(np.concatenate([language.grams(language.letters(t)) for t in texts]), return_counts=True)
    docs = spark.createDataFrame([("zh", 0, t) for t in texts], "lang string, half int, text string")
    counts = language.gram_counts(docs).drop("half")
    model = language.models_of(counts)["zh"]
    assert len(keys) > 1 << 17 and len(model.levels[4][0]) == len(keys)
    got, want = model.log_p(keys), language.Model(keys, n).log_p(keys)
    assert np.allclose(got, want, atol=1e-5)
    monkeypatch.setattr(language, "KEEP", 0)
    monkeypatch.setattr(language, "_KEPT", {})
    assert (model.log_p(keys) == got).all() and not language._KEPT
