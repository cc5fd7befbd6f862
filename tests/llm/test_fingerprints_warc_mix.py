"""Fingerprints against a sketch in plain Python, archives by round trip, mixing and counts by their totals."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from terralith.llm import fingerprints, mixing, token_counts, warc
from terralith.llm.common import scratch_dir, table

SF = "/root/testdata/sf0.001"


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chain(values, coded):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(coded(v), seed=seed)
    return seed


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", (text or "").lower()) if w]
    hashed = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    runs = [hashed[i : i + 5] for i in range(max(len(hashed) - 5, 0) + 1)] if words else []
    return {signed(chain(r, lambda v: v.to_bytes(8, "little", signed=True))) for r in runs}


def sketch_of(full):
    """Those in the lowest quarter of the range, and the least."""
    least = min(full, default=None)
    return {h for h in full if h < -(1 << 62) or h == least}


def rendered(sketch):
    return "".join(f"{h & ((1 << 64) - 1):016X}" for h in sorted(sketch))


def like(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_fingerprints_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    off = []
    for k, (i, text) in enumerate(docs):
        other, cut = docs[(k + 1) % len(docs)][1], len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        r, full = got[i], [shingles(t) for t in (text, edited, other)]
        own, changed, following = map(sketch_of, full)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == rendered(own) and r["edited_fingerprint"] == rendered(changed)
        assert r["near_edited"] == pytest.approx(like(own, changed)) and r["near_next"] == pytest.approx(like(own, following))
        assert r["inside_edited"] == pytest.approx(len(own & changed) / len(own) if own else 1.0)
        off += [abs(r["near_edited"] - like(full[0], full[1]))] if len(full[0]) > 100 else []
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)
    assert sum(off) / len(off) < 0.06


@pytest.mark.parametrize("sizes", [(1, 1), (3, 9), (100, 100), (100, 160), (160, 90), (5, 4000), (0, 7)])
def test_sketch_of_a_union_is_the_union_of_sketches(spark, sizes):
    rows = []
    for k in range(20):
        sets = [[f"{k}-{side}-{i}" if i % 3 else f"{k}-both-{i}" for i in range(n)] for side, n in enumerate(sizes)]
        rows.append((sets[0], sets[1]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    hashed = [F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))) for c in ("a", "b")]
    own = [fingerprints._kept(h, 2) for h in (*hashed, F.array_union(*hashed))]
    for merged, whole in df.select(fingerprints.merge(own[0], own[1]), own[2]).collect():
        assert merged == whole


def test_fingerprint_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (3, "another text with the same id"), (None, "null id " * 9), (9, "long " * 50000 + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit("clash")).withColumn("_id", F.lit(0))
    got = fingerprints.with_edits(docs).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    assert fingerprints.with_edits(docs.limit(0)).count() == 0
    alone = fingerprints.with_edits(docs.filter("doc_id = 9")).first()
    assert alone["edited"] == alone["text"][: alone["n_chars"] - alone["n_chars"] // 4] + alone["text"][: alone["n_chars"] // 4]


def test_sketches_merge_and_contain(spark):
    part = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(part, part + " " + " ".join(f"v{i}" for i in range(30000)))], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "x"), "b", "y")
    inside, alike, both = df.select(fingerprints.containment(F.col("x"), F.col("y")), fingerprints.likeness(F.col("x"), F.col("y")), fingerprints.merge(F.col("x"), F.col("y")) == F.col("y")).first()
    assert inside == 1.0 and 0.06 < alike < 0.13 and both


def test_successors_over_many_ranges(spark):
    ids = [3, 5, 8, 100, 101, -7, 10**12]
    got = {r["_id"]: r["next_id"] for r in fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "_id long"), parts=5).collect()}
    order = sorted(ids)
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_archives_round_trip(spark):
    big = "x" * 200
    rows = [(5, "http://a/é?q=\n1", big), (2, None, big), (None, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "é" * 99), (5, "dup", big), (12, "u", "long page " * 900000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = scratch_dir(spark)
    index = warc.write_archives(warc.classify(pages), folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[(2, "response", None)] == 1 and kinds[(5, "revisit", 2)] == 2 and kinds[(None, "revisit", 2)] == 1 and kinds[(8, "response", None)] == 1
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    assert warc.read_records(index, folder, split=300).rdd.getNumPartitions() > 1
    assert sorted(map(str, warc.read_records(index, folder, split=300).collect())) == sorted(map(str, got))
    one = warc.read_records(index.filter("page_id = 11"), folder).collect()
    assert [bytes(r["payload"]).decode() for r in one] == ["é" * 99]
    empty = scratch_dir(spark)
    assert warc.read_records(warc.write_archives(warc.classify(pages.limit(0)), empty), empty).count() == 0


def test_index_is_exact_bytes(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.classify(table(spark, SF, "pages")), folder).collect()
    import zlib

    for r in index[:20]:
        with open(f"{tmp_path}/w/{r['archive']}", "rb") as f:
            f.seek(r["offset"])
            assert warc.parse_record(zlib.decompress(f.read(r["length"]), 31))["WARC-Type"] == r["record_type"]


def test_token_histogram(spark):
    import public_tokenizers
    import tiktoken  # noqa: F401

    from terralith.llm.vocab import byte_encoder

    encode = byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary
    lengths = sorted(len(encode(r["text"] or "")) for r in table(spark, SF, "documents").select("text").collect())
    sums = token_counts.op5_token_counts(spark, SF).cache()
    assert {r["n_tokens"]: r["n_docs"] for r in sums.collect()} == Counter(lengths)
    for r in sums.collect():
        cut = r["n_tokens"]
        assert r["truncated_tokens"] == sum(min(x, cut) for x in lengths) and r["docs_at_least"] == sum(x >= cut for x in lengths) and r["tokens_below"] == sum(x for x in lengths if x < cut)
    limits = [0, 1, 100, 2048, 10**7]
    got = {r["context"]: r for r in token_counts.context_totals(sums, limits).collect()}
    for c in limits:
        assert (got[c]["kept_tokens"], got[c]["docs_over"], got[c]["total_tokens"]) == (sum(min(x, c) for x in lengths), sum(x > c for x in lengths), sum(lengths))
    median = token_counts.quantiles(sums, [0.5, 1.0]).collect()
    assert {r["share"]: r["n_tokens"] for r in median} == {0.5: lengths[-(-len(lengths) // 2) - 1], 1.0: lengths[-1]}


def test_token_odd_rows(spark):
    docs = spark.createDataFrame([(None,), ("",), ("<|endoftext|>",), ("a " * 30000,), ("a " * 30000,)], "text string").withColumn("n_tokens", F.lit(1))
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(docs)))
    assert {r["n_tokens"]: r["n_docs"] for r in sums.collect()}[0] == 2
    empty = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(docs.limit(0))))
    assert empty.count() == 0 and token_counts.context_totals(empty, [5]).first()["kept_tokens"] == 0


def test_mix_totals_and_reruns(spark):
    got = mixing.op6_mix_sources(spark, SF).toPandas()
    again = mixing.op6_mix_sources(spark, SF).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()
    assert (got["taken"] <= 2 * got["size"]).all()
    for _, rows in got.groupby("source"):
        target, longest = rows["target"].iloc[0], rows["size"].max()
        assert abs(rows["taken"].sum() - target) <= longest and target <= 2 * rows["source_size"].iloc[0]
    assert abs(got.drop_duplicates("source")["target"].sum() - 1.5 * got["size"].sum()) < 1


def test_mix_weights_matter(spark):
    docs = spark.createDataFrame([(i, "one two three four", "s") for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 20.0 if i < 100 else 0.05) for i in range(400)], "doc_id long, weight double")
    got = mixing.mix(docs, total_share=0.25, quality=weights).filter("taken > 0").collect()
    assert len(got) == 100 and sum(r["doc_id"] < 100 for r in got) > 90


def test_mix_odd_rows(spark):
    rows = [(1, None, None), (2, "", "b"), (3, "a b", "b"), (3, "a b", "b"), (None, "c d e", "a"), (5, "x " * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0)).withColumn("_range", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and all(r["taken"] <= 2 * r["size"] for r in got) and mixing.mix(docs.limit(0)).count() == 0
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["epochs"] + r["selected"] for r in got)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1], [0, 5, 5], [0, 0, 0], [7]])
def test_targets_are_a_water_level(spark, sizes):
    rows = [(f"s{i}", n, 1) for i, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long, n_docs long")).collect()}
    left, free, want = 1.5 * sum(sizes), {i: mixing.WEIGHTS[i % 3] for i in range(len(sizes))}, {}
    while free:
        share = {i: left * w / sum(free.values()) for i, w in free.items()}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            want |= share
            break
        for i in over:
            want[i] = 2.0 * sizes[i]
            left -= want[i]
            del free[i]
    assert all(abs(got[f"s{i}"] - want[i]) < 1e-6 for i in range(len(sizes)))


def test_ranges_of_heavy_weights(spark, monkeypatch):
    """Weights of 1000 and a hot source: no range of a source's keys holds more than four times its mean, and targets are
    met."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.format_string("one two %d", "id").alias("text"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    seen, plain = [], mixing._in_ranges
    monkeypatch.setattr(mixing, "_in_ranges", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = mixing.mix(docs, quality=docs.select("doc_id", F.lit(1000.0).alias("weight")))
    sizes = {}
    for r in seen[0].groupBy("source", "_range").count().collect():
        sizes.setdefault(r["source"], []).append(r["count"])
    assert len(sizes) == 8 and all(len(v) > 100 and max(v) <= 4 * sum(v) / len(v) for v in sizes.values())
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 3
