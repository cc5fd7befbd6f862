"""Importance resampling and filter audit against brute force, toxicity on planted sentences; odd input for all three."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import filter_audit, importance, toxicity
from terralith.llm.common import class_sample, table

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score string, rank string, _key string, mask string"
ODD = [None, "", "   \n", "Aé b字c 9Z_z " * 3, "x" * 300 + " y", "one two three", "one two three", "🙂 word word", "WORD# " * 60, "long text of words " * 30_000, "Shout LOUD"]


def odd_rows():
    rows = [(i, t, None, [None, "", "s1", "s2"][i % 4], None, "c", "c", "c", "c", "c") for i, t in enumerate(ODD)]
    return [*rows, rows[5], (None, "one two three", "en", "s1", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text):
    w = WORDS.findall(lowered(text))
    return len(w), [" ".join(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1)]


def brute_resample(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) of (doc_id, text), by dictionaries."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in brute_features(t)[1])
    t = Counter(bucket(f) for x in target for f in brute_features(x)[1])
    big, small = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, text in docs:
        n, features = brute_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return out


def columns(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_resample_on_the_smallest_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    target = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert columns(importance.op11_resample(spark, SF)) == Counter(map(tuple, brute_resample(docs, target)))


def test_resample_odd_rows(spark):
    rnd = random.Random(3)
    more = [(100 + i, " ".join(rnd.choice("abcdefg") + rnd.choice("xyz") for _ in range(rnd.randrange(15, 60))), *[None] * 8) for i in range(300)]
    rows = odd_rows() + more + more[:40]  # 40 repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    target = ["ax by cz " * 20, None, ""]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    want = brute_resample([(r[0], r[1]) for r in rows], target)
    assert columns(got) == Counter(map(tuple, want)) and sum(r[4] is not None for r in want) > 10
    assert importance.resample(docs.limit(0), docs.limit(0)).collect() == []
    assert columns(importance.resample(docs, docs.limit(0))) == Counter(map(tuple, brute_resample([(r[0], r[1]) for r in rows], [])))


def test_ranks_over_ranges(spark):
    """A third of all rows with one score and id, others distinct: ranks are 1 to the number asked for."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50).cast("long").alias("score")).repartition(6)
    for count in (0, 1, 1234, 3000, 9999):
        got = [r["rank"] for r in importance.ranked(df, count, [F.desc("score"), F.asc_nulls_last("doc_id")], ["doc_id", "score"]).collect()]
        assert sorted(r for r in got if r) == list(range(1, min(count, 3000) + 1)) and len(got) == 3000
    ordered = importance.ranked(df, 3000, [F.desc("score"), F.asc_nulls_last("doc_id")], ["doc_id", "score"]).orderBy("rank").collect()
    assert all((-a["score"], a["doc_id"]) <= (-b["score"], b["doc_id"]) for a, b in itertools.pairwise(ordered))


def brute_audit(docs, labels):
    """Every order applied to every document, one after another."""
    best = {}
    for i, q, x in labels:
        if i is not None:
            a = best.setdefault(i, [0, 0])
            a[0], a[1] = max(a[0], q or 0), max(a[1], x or 0)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    parts = {s or "" for _, _, s in docs}
    for p in parts:
        for order in itertools.permutations("ABCDE"):
            for k in range(5):
                for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    out[p, "".join(order), k + 1, c] = 0
    total = Counter()
    for i, t, s in docs:
        t, p = t or "", s or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)) if bad}
        good, toxic = (int(x == 1) for x in best.get(i, (0, 0)))
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order, 1):
                key = (p, "".join(order), k)
                if f in fails:
                    out[*key, "unique_fails"] += len(fails) == 1
                    out[*key, "redundant" if gone else "removed"] += 1
                    if not gone:
                        out[*key, "good_lost"] += good
                        out[*key, "toxic_lost"] += toxic
                        total[p, f] += 1
                    gone = True
                out[*key, "kept"] += not gone
    return out, total


def test_audit_odd_rows(spark):
    rnd = random.Random(5)
    rows = [r[:4] for r in odd_rows()]
    for i in range(120):
        text = " ".join(rnd.choice(["aa", "Bb", "cc#", "d", f"w{rnd.randrange(90)}"]) for _ in range(rnd.randrange(0, 110)))
        rows.append((200 + i, rnd.choice([text, "same text", None]), None, rnd.choice([None, "", "s1"])))
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 320, 2), 4, None, 4]]
    docs = spark.createDataFrame([(*r, None, "c", "c", "c", "c", "c") for r in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, total = brute_audit([(r[0], r[1], r[3]) for r in rows], labels)
    got = filter_audit.audit(docs, marks).collect()
    assert len(got) == 600 * len({p for p, *_ in want})
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert {c: r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")} == {c: want[*key, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
        assert r["shapley"] == total[r["part"], r["filter_order"][r["step"] - 1]]
    assert filter_audit.audit(docs.limit(0), marks).collect() == [] and filter_audit.audit(docs, marks.limit(0)).count() == len(got)


def test_audit_of_a_large_group_of_copies(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"), F.lit("s").alias("source"))
    r = {x["filter_order"]: x for x in filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("step = 1").collect()}
    assert r["EABCD"]["removed"] == 1333 and r["ABCDE"]["removed"] == 4000


# --- toxicity ------------------------------------------------------------------------------------------


def corpus(seed, n, stems=("grobix", "smurl", "vetch")):
    """(text, toxic, spans): sentences of invented words; toxic texts have one to three with an offending stem."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulrstnm") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    out = []
    for _ in range(n):
        parts = [[rnd.choice(words) for _ in range(rnd.randrange(4, 15))] for _ in range(rnd.randrange(1, 25))]
        toxic = rnd.random() < 0.25
        for s in rnd.sample(range(len(parts)), min(len(parts), rnd.randrange(1, 4))) if toxic else []:
            parts[s].insert(rnd.randrange(len(parts[s])), rnd.choice(stems) + rnd.choice(["", "ia", "ous", "nt"]))
        text, spans = "", []
        for s in parts:
            begin = len(text)
            text += " ".join(s).capitalize() + rnd.choice([".", "!", "?", "\n"])
            if any(w.startswith(stems) for w in s):
                spans.append((begin, len(text) - 1))
            text += " "
        out.append((text, int(toxic), spans))
    return out


def test_model_finds_documents_and_sentences():
    rows = corpus(1, 1500)
    train, test = rows[:1000], rows[1000:]
    y = np.array([r[1] for r in train])
    model = toxicity.fit([r[0] for r in train], y, np.array([(y == 0).sum(), (y == 1).sum()], float))
    scores, (owner, start, end, p) = model.measure([r[0] for r in test])
    said = scores >= toxicity.THRESHOLD
    truth = np.array([r[1] for r in test]) == 1
    assert said[truth].mean() > 0.97 and said[~truth].mean() < 0.01
    found = {(int(o), int(a), int(b)) for o, a, b, q in zip(owner, start, end, p) if q >= toxicity.OFFENDS}
    planted = {(i, a, b) for i, r in enumerate(test) for a, b in r[2]}
    assert len(found & planted) > 0.95 * len(planted) and len(found - planted) < 0.02 * len(planted)


def test_scores_are_noisy_or():
    model = toxicity.Model(np.random.default_rng(2).normal(0, 0.5, toxicity.PLACES).astype(np.float32), -3.0)
    texts = ["Un deux trois. Quatre!\nCinq six", "", "…", "seul", "a.b c.d 3.14 http://x.y/z", "mot " * 200]
    scores, (owner, start, end, p) = model.measure(texts)
    for i, text in enumerate(texts):
        mine = owner == i
        assert scores[i] == pytest.approx(1 - np.prod(1 - p[mine]), abs=1e-9)
        whole = [text[a:b] for a, b in zip(start[mine], end[mine])]
        assert sum(len(re.findall(r"\w+", w)) for w in whole) == len(re.findall(r"\w+", text))
        for w, q in zip(whole, p[mine]):  # a sentence alone has the same score
            assert model.measure([w])[0][0] == pytest.approx(q, abs=1e-9)
    assert [text[a:b] for text in texts[:1] for a, b in zip(start[owner == 0], end[owner == 0])] == ["Un deux trois", "Quatre", "Cinq six"]
    assert (owner == 4).sum() == 1 and (owner == 5).sum() == 4 and scores[1] == scores[2] == 0


def test_gradient_raises_the_likelihood():
    rows = corpus(4, 300)
    texts, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    shares = np.array([(y == 0).sum(), (y == 1).sum()], float)
    fitted, none = toxicity.fit(texts, y, shares), toxicity.Model(np.zeros(toxicity.PLACES, np.float32), -5.0)
    loss = lambda m: -np.mean(np.where(y > 0, np.log(np.maximum(m.measure(texts)[0], 1e-12)), np.log1p(-np.minimum(m.measure(texts)[0], 1 - 1e-12))))
    assert loss(fitted) < 0.1 * loss(none)


def test_fit_without_a_class():
    same = toxicity.fit(["a b", "c d"], np.array([0, 0]), np.array([2.0, 0.0]))
    assert (same.measure(["a b", "", "zz"])[0] < 0.01).all()
    assert np.isfinite(toxicity.fit([], np.array([]), np.array([0.0, 0.0])).bias)
    assert np.isfinite(toxicity.fit(["", "..."], np.array([1, 0]), np.array([1.0, 1.0])).measure(["x"])[0]).all()


def test_toxicity_odd_rows(spark):
    rows = corpus(7, 240)
    docs = [(1000 + i, t, None, "s", None, "c", "mine", "c", "c", "c") for i, (t, _, _) in enumerate(rows)]
    df = spark.createDataFrame(odd_rows() + docs + docs[:5], SCHEMA)
    labels = spark.createDataFrame([(1000 + i, 1, y) for i, (_, y, _) in enumerate(rows)] + [(0, None, None), (1, 0, 0), (None, 1, 1), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.with_labels(df, labels), df)
    got = toxicity.score(df, model)
    assert set(df.columns) | {"score", "predicted", "n_sentences", "offending"} == set(got.columns)
    held = got.collect()
    by_text = {}
    for r in held:
        assert 0 <= r["score"] <= 1 and by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert len(held) == df.count() and all(r["score"] == 0 for r in held if not (r["text"] or "").strip())
    truth = {1000 + i: y for i, (_, y, _) in enumerate(rows)}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.97
    for r in toxicity.offending_sentences(df, model).limit(50).collect():
        assert r["sentence"] and r["end"] - r["start"] == len(r["sentence"])
    assert toxicity.score(df.limit(0), model).count() == 0
    bare = toxicity.train(toxicity.with_labels(df, labels.limit(0)), df)
    assert toxicity.score(df, bare).filter("score NOT BETWEEN 0 AND 1").count() == 0


def test_toxicity_held_out(spark):
    got = toxicity.op13_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert got.loc[toxic, "predicted"].mean() > 0.7 and got.loc[~toxic, "predicted"].mean() < 0.015


def test_class_sample_has_texts_of_each_class(spark):
    """Texts larger than the whole budget: a class still gets the least texts there are, the smallest first."""
    rows = [(0, i, 10) for i in range(100)] + [(1, i, 1000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "label int, order long, size long")
    got = Counter((r["label"]) for r in class_sample(df, (0, 1), 60, 400, 5).collect())
    assert got == {0: 20, 1: 5}
    assert sorted(r["order"] for r in class_sample(df, (0, 1), 60, 400, 5).filter("label = 1").collect()) == [0, 1, 2, 3, 4]
    assert class_sample(df.limit(0), (0, 1), 60, 400, 5).count() == 0
    assert Counter(r["label"] for r in class_sample(df, (0, 1), 60, 1 << 20, 5).collect()) == {0: 30, 1: 30}
