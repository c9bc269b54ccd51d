"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from logjury.llm import (
    chat,
    divergence,
    filters,
    language,
    licenses,
    mixing,
    packing,
    pages,
    pii,
    quality,
    rules,
    simhash,
    vectors,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_chat": chat.op2_chat,
    "op3_main_text": pages.op3_main_text,
    "op4_quality": quality.op4_quality,
    "op5_pack": packing.op5_pack,
    "op6_simhash": simhash.op6_simhash,
    "op7_embedding_links": vectors.op7_embedding_links,
    "op8_language": language.op8_language,
    "op9_licenses": licenses.op9_licenses,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_pii": pii.op11_pii,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_chat": chat.OP2_SQL,
    "op7_embedding_links": vectors.OP7_SQL,
    "op12_filter_audit": filters.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
