"""Columns and types of the registered queries, and that the rest of the library does without this subpackage."""

import subprocess
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4": {"doc_id": "bigint", "class_id": "bigint"},
    "op6": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op11": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12": {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint"),
    "op13": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns(spark, op):
    name = next(n for n in __spark_entry__.queries() if n.startswith(f"{op}_"))
    got = dict(__spark_entry__.queries()[name](spark, SF).dtypes)
    assert {c: got.get(c) for c in COLUMNS[op]} == COLUMNS[op]


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_oracles_name_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_alone():
    code = "import sys; sys.modules['terralith.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op1') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__spark_entry__.__file__.rsplit("/", 1)[0], capture_output=True).returncode == 0


@pytest.mark.parametrize("name", ["op2_warc", "op6_mix_sources", "op9_topk", "op12_filter_audit"])
def test_sql(spark, name):
    import os

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__spark_entry__.__file__)), "tests"))
    from oracle import differences

    assert differences(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], SF) == ""
