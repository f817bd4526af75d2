"""Registered queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from codecensus.llm import (
    collocations,
    exact_dedup,
    fingerprints,
    licenses,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    scoring,
    urls,
)

QUERIES = {
    "op1_personal_data": pii.op1,
    "op2_lm_scoring": scoring.op2,
    "op3_mixing": mixing.op3,
    "op4_licenses": licenses.op4,
    "op5_quality_rules": quality.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_packing": packing.op7,
    "op8_url_filter": urls.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_ngram_join": ngram_join.op10,
    "op11_exact_dedup": exact_dedup.op11,
    "op12_collocations": collocations.op12,
    "op13_merkle_manifest": merkle.op13,
}

ORACLES = {
    "op5_quality_rules": quality.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
