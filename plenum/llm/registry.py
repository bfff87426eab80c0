"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import conversation_repair, embedding_dedup, hard_negatives, minhash_dedup, packing, pii, piece_sampling, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_packing": packing.op5_packing,
    "op6_piece_sampling": piece_sampling.op6_piece_sampling,
    "op7_pii": pii.op7_pii,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {"op2_warc": warc.SQL, "op3_quality_rules": quality_rules.SQL, "op4_embedding_dedup": embedding_dedup.SQL, "op12_url_filter": url_filter.SQL, "op13_hard_negatives": hard_negatives.SQL}
