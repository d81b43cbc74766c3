"""Queries of the corpus operators and the SQL that some of them can be compared with."""

from __future__ import annotations

from quillstream.llm import automata, containment, divergence, line_dedup, mixing, phrases, pii, quality, revisits, sentence_pieces, sharding, signature_join, suffix_dedup

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_revisits": revisits.query,
    "op3_suffix_array_dedup": suffix_dedup.query,
    "op4_substring_dedup": automata.query,
    "op5_line_dedup": line_dedup.query,
    "op6_pii": pii.query,
    "op7_jaccard_join": signature_join.query,
    "op8_sharding": sharding.query,
    "op9_quality_rules": quality.query,
    "op10_decontamination": containment.query,
    "op11_source_divergence": divergence.query,
    "op12_sentence_pieces": sentence_pieces.query,
    "op13_phrases": phrases.query,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op2_revisits": revisits.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op10_decontamination": containment.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
