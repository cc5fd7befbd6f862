"""The pipeline stage by stage: columns, what goes, what stays."""

import corpus_pipeline
from terralith.llm import bpe, language, mixing, neardup, quality
from terralith.llm.common import materialize, table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, frames = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = (docs, out := materialize(stage(spark, docs, SF)))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        docs = out
    before, after = frames["language"]
    assert after.count() >= 0.98 * before.count()
    before, after = frames["quality"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    held = [r["doc_id"] for r in before.filter(quality.held_out()).collect() if r["doc_id"] in labels]
    assert sum((i in kept) == bool(labels[i]) for i in held) > 0.95 * len(held)
    before, after = frames["near_duplicates"]
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for c in classes.values()})
    before, after = frames["mix"]
    mixed = mixing.mix(before, quality=mixing.label_weights(table(spark, SF, "labels"))).collect()
    times = {r["doc_id"]: r["epochs"] + r["selected"] for r in mixed if r["epochs"] + r["selected"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == times
    before, after = frames["encode"]
    assert after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and after.count() == before.count()
    assert sorted(map(tuple, bpe.digests(bpe.encode_documents(before)).collect())) == sorted(map(tuple, after.collect()))


def test_rejected_languages_go(spark):
    docs = spark.createDataFrame([(i, "the of and to in that " * 9, "en", "s", 1) for i in range(40)] + [(99, "12 ###", "en", "s", 6), (98, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.identify_language(spark, docs, SF)
    assert {r["doc_id"] for r in left.collect()} == set(range(40)) and language.UNKNOWN == "und"


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score double, _id string, _text string, taken long"


def odd_docs(spark):
    """Null, empty, very long, tied and repeated rows, null ids and sources, and columns with names of helpers."""
    good = "the quick brown fox jumps over the lazy dog and runs to the river bank near the old mill where people sit in the sun"
    texts = [good, good, good + " again", None, "", " \n", "12 ###", good.upper(), "clean words of another kind entirely " * 3, "word " * 200_000, "### $$$ %%% " * 20, "### $$$ %%% @@@ " * 30]
    rows = [(i, t, [None, "en"][i % 2], [None, "", "s1"][i % 3], None, "x", 1.5, "y", "z", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[8], (None, good + " for a null id", "en", "s1", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)], ODD_SCHEMA)


def test_every_stage_takes_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(i, int(i not in (10, 11)), 0) for i in range(12)] + [(0, None, None), (None, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark)
    all_rows = sorted(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        kept = list(map(repr, out.collect()))
        assert set(kept) <= set(all_rows), name  # rows stay as they are
        if name == "language":
            assert not [r for r in out.collect() if not (r["text"] or "").strip() or r["text"] == "12 ###"]
        elif name == "near_duplicates":
            texts = [r["text"] for r in out.collect()]
            assert len({t or "" for t in texts}) == len(texts) and 0 in {r["doc_id"] for r in out.collect()}
        elif name == "mix":
            assert all((r["text"] or "").strip() or kept.count(repr(r)) <= 2 for r in out.collect())
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, docs, str(tmp_path)).collect()
    assert len(out) == docs.count() and sum(r["n_tokens"] == 0 for r in out) >= 3


def test_every_stage_takes_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()  # without labels all stay


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd_docs(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
