"""What a Python worker holds at once and keeps, and how often texts are dealt out."""

import numpy as np
import pyarrow as pa

from terralith.llm import common, neardup


def test_cells_turn_texts_into_strings_by_slices(monkeypatch):
    texts = [f"{k} " + " ".join(f"w{i}" for i in range(8000)) for k in range(30)] + ["short text of a few words", ""]
    samples = np.arange(2 * neardup.SAMPLES, dtype=np.uint16).tobytes()
    members = [{"left": True, "tid": 100 - i, "class": 100 - i, "samples": samples, "_text": t} for i, t in enumerate(texts[:-1])]
    sizes, distinct = [], neardup._distinct
    monkeypatch.setattr(neardup, "_distinct", lambda part: sizes.append(sum(map(len, part))) or distinct(part))
    frequent = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    links = neardup._cell_links(0, True, members, frequent, 0.8)
    assert sum(sizes) > 1 << 20 and max(sizes) <= 1 << 19
    # the 30 long texts are one class, and members and sets stay together whatever their order
    assert len(links) == 29 and {t for link in links for t in link} == set(range(71, 101))
    apart = [{k: v for k, v in m.items() if k != "_text"} for m in members]
    assert neardup._cell_links(0, True, apart, frequent, 0.8, pa.array(texts[:-1])) == links


def test_tables_of_powers_for_long_texts_are_not_kept(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", common.Powers())
    short = common.word_hashes(["alpha beta gamma"])[0]
    long = common.word_hashes(["alpha beta gamma " * 200_000])[0]
    assert (long.reshape(-1, 3) == short).all()
    assert len(common._POWERS.up) <= (1 << 21) + 1


def test_deduplicated_deals_texts_out_once(spark):
    rows = [(1, "the same words here twice over", "a"), (1, "the same words here twice over", "a"), (2, "the same words here twice over", "b"), (None, None, "c"), (None, None, "c"), (7, "other words that stand alone now", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = neardup.deduplicated(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning(_own_key") == 1
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [rows[0], rows[3], rows[5]]))
