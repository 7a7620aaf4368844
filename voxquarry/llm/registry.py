"""Queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from voxquarry.llm import byte_bpe, collision_search, compression_quality, decontaminate, language_id, line_dedup, mixing, ngram_join, pseudonyms, substring_dedup, token_links, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_collision_search": collision_search.op6_collision_search,
    "op7_compression_quality": compression_quality.op7_compression_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_pseudonyms": pseudonyms.op9_pseudonyms,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_whitening": whitening.op12_whitening,
    "op13_token_links": token_links.op13_token_links,
}
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
