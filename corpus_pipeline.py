"""From raw documents to encoded training text: five stages, each written as Parquet and read again by the next.

Each stage takes documents (doc_id, text, lang, source and any other columns, of whatever names) and all but the last
return the same columns.  Null text counts as empty, repeated rows are rows of their own, ties are settled by id or by
code point, texts of any length are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralith.llm import bpe, language, mixing, neardup, quality
from terralith.llm.common import drop_scratch, materialize, scratch_mark, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the language models, learned from these documents' lang, reject: texts without a
    letter (null and empty ones too) and texts that are like no learned language.  Without any lang all go."""
    return language.accepted(docs, language.train(docs.filter(~language.held_out())))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier, learned from the labelled ones, rejects.  Documents are scored
    by text alone; without labels all have the score 0.5 and stay."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(quality.with_labels(docs.filter(~quality.held_out()), labels.filter(~quality.held_out())))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id, null ids last."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words are never taken beyond whole epochs."""
    return mixing.mixed_rows(docs, quality=mixing.label_weights(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and, of every document, the number of ids and digests of ids and decoded text (see op10_bpe)."""
    return bpe.digests(bpe.encode_documents(docs))


STAGES = [
    ("language", identify_language),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Trained models and sampled similarities are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote for itself goes once its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark(spark)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_scratch(spark, mark, keep=1)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
