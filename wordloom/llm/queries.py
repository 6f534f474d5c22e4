"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from wordloom.llm import compression, media, mixing, packing, passages, quality_rules, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_media_sequences": media.op1_media_sequences,
    "op2_suffix_array_dedup": passages.op2_suffix_array_dedup,
    "op3_compression_quality": compression.op3_compression_quality,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_toxicity_lexicon": toxicity.op7_toxicity_lexicon,
    "op8_range_sharding": sharding.op8_range_sharding,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_warc_chunks": warc.op10_warc_chunks,
}
SQL = {"op10_warc_chunks": warc.SQL}
