"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import alignment, avi, byte_bpe, hnsw, merkle, mixing, passages, quality, rules, simhash, token_files, trie_counts, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_simhash_components": simhash.op2_simhash_components,
    "op3_warc_captures": warc.op3_warc_captures,
    "op4_passage_dedup": passages.op4_passage_dedup,
    "op5_token_counts": trie_counts.op5_token_counts,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_avi_media": avi.op7_avi_media,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_hnsw_search": hnsw.op9_hnsw_search,
    "op10_token_files": token_files.op10_token_files,
    "op11_quality_rules": rules.op11_quality_rules,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES: dict[str, str] = {"op3_warc_captures": warc.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
