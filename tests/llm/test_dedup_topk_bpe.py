"""Near-duplicate classes, top-k and BPE against brute force; odd input."""

import hashlib
import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import bpe, neardup, topk
from terralith.llm.common import shingle_hashes, table
from terralith.llm.components import components
from terralith.llm.vocab import default_path, word_tokenizer

SF = "/root/testdata/sf0.001"


# --- near duplicates --------------------------------------------------------------------------------


def near_copies(n_base=12, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    docs = []
    for _ in range(n_base):
        base = [word() for _ in range(rng.randint(60, 300))]
        docs.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    docs += [docs[0], docs[0]]
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def brute_classes(rows, frequent):
    """Union-find over all pairs with weighted or plain similarity of 0.8."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a == b or max(neardup.similarities(a, b, frequent)) >= 0.8:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_classes_against_all_pairs(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = neardup.frequent_shingles(docs.select(F.col("text").alias("_text")))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == brute_classes(rows, frequent)
    assert len(set(got.values())) < len(rows)


def test_shared_tables_classes(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").collect()]
    frequent = neardup.frequent_shingles(table(spark, SF, "documents").select(F.coalesce("text", F.lit("")).alias("_text")))
    got = {r["doc_id"]: r["class_id"] for r in neardup.op4_near_duplicates(spark, SF).collect()}
    assert got == brute_classes(rows, frequent)


def test_frequent_shingles_are_exact(spark):
    rows = [(f"common words stand in all texts here {i} {i % 3} then five words that {i % 50} repeat",) for i in range(1500)]
    h, idf = neardup.frequent_shingles(spark.createDataFrame(rows, "_text string").repartition(3))
    counts = {}
    for s in shingle_hashes([r[0] for r in rows]):
        for x in set(s.tolist()):
            counts[x] = counts.get(x, 0) + 1
    want = {x: n for x, n in counts.items() if n >= max(2, 1500 / neardup.RARE)}
    assert dict(zip(h.tolist(), [round(float(v), 4) for v in idf])) == {x: round(min(2, max(1, 1 + np.log(1500 / n) / np.log(neardup.RARE))), 4) for x, n in want.items()}


def test_samples_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 1 << 63, 600).astype(np.uint64)
    w = rng.uniform(1, 4, 600).astype(np.float32)
    v = w.copy()
    v[:100] *= 0.25
    want = float(np.minimum(v[:500], w[:500]).sum() / (w[:500].sum() + v.sum() - np.minimum(v[:500], w[:500]).sum()))
    got = []
    for shift in range(60):  # other shingles, other samples
        g = neardup.mix64(h + np.uint64(shift))
        a = neardup.weighted_samples(g[:500], w[:500], np.array([0]))
        b = neardup.weighted_samples(g, v, np.array([0]))
        got.append((a == b).mean())
    assert abs(np.mean(got) - want) < 0.03


def test_large_group_of_near_copies_stays_linear(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in neardup.classes(docs).collect()} == {0}
    full = docs.select("doc_id", F.lit("k").alias("text_key"), F.col("text").alias("_text"))
    signed = neardup.signed(full, neardup.frequent_shingles(full.select("_text")))
    members = signed.select(F.col("doc_id").alias("tid"), F.explode("bands").alias("bucket"))
    assert neardup.star_pairs(members).count() <= 400 * 14


def test_plain_links_of_repeated_passages(spark):
    """A row repeated 400 times against 100: term counts pull the weighted similarity to 0.4, the plain one is 0.9."""
    rng, rows = random.Random(4), []
    for i in range(40):
        words, row = [f"w{rng.randrange(10**6)}" for _ in range(300)], " ".join(f"r{i}c{k}" for k in range(5)) + " "
        other = words[:150] + [f"n{i}"] + words[150:]
        other[40] = f"m{i}"
        rows += [(2 * i, row * 400 + " ".join(words)), (2 * i + 1, row * 100 + " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weighted, plain = neardup.similarities(rows[0][1], rows[1][1], neardup.frequent_shingles(docs.select(F.col("text").alias("_text"))))
    assert weighted < 0.4 and plain > 0.9
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == {i: i - i % 2 for i, _ in rows}
    members = docs.select(F.col("doc_id").alias("doc_id"), F.lit("k").alias("text_key"), F.col("text").alias("_text"))
    frequent = neardup.frequent_shingles(members.select("_text"))
    signed = {r["doc_id"]: bytes(r["samples"]) for r in neardup.signed(members, frequent).collect()}
    for i in range(0, 80, 2):  # the cells' prefilter lets each pair through
        cell = [{"left": True, "tid": j, "class": j, "samples": signed[j], "_text": rows[j][1]} for j in (i, i + 1)]
        assert any(neardup._cell_links(band, True, cell, frequent, 0.8) for band in range(2 * neardup.SAMPLES // neardup.ROWS))


@pytest.mark.parametrize("block", [2, 5, 512])
def test_cells_find_every_link(spark, monkeypatch, block):
    """All members in one bucket, one class of seven already known: the links join what all pairs would join."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "AT_ONCE", 3)
    rows = near_copies(6, seed=8)
    docs = spark.createDataFrame(rows, "doc_id long, _text string").withColumn("text_key", F.lit("k"))
    frequent = neardup.frequent_shingles(docs.select("_text"))
    signed = neardup.signed(docs, frequent).select(F.col("doc_id").alias("tid"), "samples")
    # the same band everywhere: the check for the first shared band must not hide any pair here
    members = signed.withColumn("bytes", F.lit(300)).crossJoin(spark.range(14).select(F.col("id").cast("int").alias("band"))).withColumn("bucket", F.col("band").cast("long"))
    members = members.withColumn("class", F.when(F.col("tid") < 7, F.lit(0)).otherwise(F.col("tid")))
    links = [(r["a"], r["b"]) for r in neardup.cross_links(members, docs.select(F.col("doc_id").alias("tid"), "_text"), frequent, 0.8).collect()]
    edges = links + [(0, i) for i in range(7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_classes(rows, frequent)
    merged = {want[i] for i in range(7)}
    want = {i: 0 if c in merged else c for i, c in want.items()}
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "two words"), (None, "only null ids"), (None, "only null ids"), (7, "y " * 50000), (8, "y " * 50001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("clash")).withColumn("_text", F.lit("x"))
    got = neardup.classes(docs).collect()
    classes = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"]) for r in got)
    assert classes == [(-1, -1), (-1, -1), (-1, 3), (1, 1), (2, 1), (3, 3), (3, 3), (7, 7), (8, 7)]
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 7]
    assert neardup.classes(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (103, 101), (50, 50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 103: 100}


# --- top-k ------------------------------------------------------------------------------------------


def brute_topk(queries, rows, k):
    out = []
    for i, q in queries:
        scored = sorted((-int(np.floor(256 * np.array(q, float)) @ np.floor(256 * np.array(c, float))), j) for j, c in rows if j != i and len(c) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_topk_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(30)] + [(100 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.search(df.filter("vec_id % 10 = 0"), df, k).collect())
    assert got == brute_topk([r for r in rows if r[0] % 10 == 0], rows, k)


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (7, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.search(df.filter("vec_id % 50 = 0"), df, 5).collect())
    assert got == [(0, 1, 50, 196608), (0, 2, 50, 196608), (0, 3, 7, -196608), (50, 1, 0, 196608), (50, 2, 7, -131072)]
    assert topk.search(df.limit(0), df, 5).count() == 0 and topk.search(df, df.limit(0), 5).count() == 0


# --- BPE --------------------------------------------------------------------------------------------

TEXTS = [
    "Hello  world's İstanbul ÇA été don't 12.5 ### ñ́ <|endoftext|> x ΣΑΣ ß ǅ", None, "", "   ", "a<|startoftext|>B<|endoftext|>", "你好 مرحبا ٣ ½ \x85 \x1c ​ é ﬁ K Å 👩‍👩‍👧",
    "I'LL we'Re 'sx <|END|> \0 x\0y", "\0<|endoftext|>", "word " * 40000, "z" * 5000, "Hello  world's",
]


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_bpe_is_the_tokenizers_library(spark, hot):
    rows = list(enumerate(TEXTS)) + [(r["doc_id"] + 100, r["text"]) for r in table(spark, SF, "documents").limit(80).collect()]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.digests(bpe.encode_documents(docs, hot=hot)).collect()
    assert len(got) == len(rows) + 1
    tokenizer, want = word_tokenizer(default_path(bpe.VOCABULARY)), {}
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_bpe_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs).count() == 0


def test_pairs_of_blocks_carry_names_only(spark, monkeypatch):
    """What a pair of blocks sends between tasks doesn't grow with the queries of a block."""
    from terralith.llm import topk

    monkeypatch.setattr(topk, "QUERIES", 64)
    monkeypatch.setattr(topk, "CANDIDATES", 128)
    seen, plain = [], topk._pair_up
    monkeypatch.setattr(topk, "_pair_up", lambda *a: seen.append(plain(*a)) or seen[-1])
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.search(df.filter("vec_id % 3 = 0"), df, 5).collect()
    assert len(got) == 5 * 234
    v = np.floor(256 * np.array([r[1] for r in rows]))
    for q in range(0, 700, 33):
        score = (v @ v[q]).astype(np.int64)
        want = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        assert sorted((-r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == want
    for pairs in seen:
        assert not {"ids", "lows"} & set(pairs.columns) and max(len(repr(r)) for r in pairs.limit(20).collect()) < 400
