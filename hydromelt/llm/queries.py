"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from hydromelt.llm import (
    bpe_codec, contamination, merkle, near_dups, piece_codec, quality_rules, sharding, substrings, token_counts, toxicity, urls,
    warc, whitening)

QUERIES = {fn.__name__: fn for fn in (
    sharding.op1_virtual_slots, token_counts.op2_rank_synchronous, warc.op3_warc_zstd, quality_rules.op4_weak_supervision,
    substrings.op5_de_bruijn, near_dups.op6_circulant_minhash, contamination.op7_latent_semantic, bpe_codec.op8_speculate_verify,
    toxicity.op9_naive_bayes_linear, urls.op10_blocked_bloom, whitening.op11_feast_whitening, merkle.op12_lag_lead_manifest,
    piece_codec.op13_distinct_chunks)}
#: The others have tests against brute force: their results hang on hashes, trained models or a tokenizer file.
ORACLES = {"op3_warc_zstd": warc.OP3_SQL, "op5_de_bruijn": substrings.OP5_SQL, "op6_circulant_minhash": near_dups.OP6_SQL,
           "op10_blocked_bloom": urls.OP10_SQL, "op12_lag_lead_manifest": merkle.OP12_SQL}
