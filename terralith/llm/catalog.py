"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from terralith.llm import bpe, filter_audit, fingerprints, importance, language, licenses, mixing, neardup, quality, token_counts, topk, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op3_quality": quality.op3_quality,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op7_language": language.op7_language,
    "op8_licenses": licenses.op8_licenses,
    "op9_topk": topk.op9_topk,
    "op10_bpe": bpe.op10_bpe,
    "op2_warc": warc.op2_warc,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op11_resample": importance.op11_resample,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op9_topk": topk.OP9_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
