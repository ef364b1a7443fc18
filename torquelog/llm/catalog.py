"""The registered queries of this subpackage and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from torquelog.llm import (
    chat,
    decontaminate,
    fingerprints,
    hard_negatives,
    language_id,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    quality,
    secrets,
    sharding,
    warc,
)

QUERIES = {
    "op1_secret_links": secrets.query,
    "op2_chat_preferences": chat.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_quality_classifier": quality.query,
    "op5_rendezvous_sharding": sharding.query,
    "op6_best_fit_packing": packing.query,
    "op7_language_id": language_id.query,
    "op8_benchmark_decontamination": decontaminate.query,
    "op9_weighted_fingerprints": fingerprints.query,
    "op10_line_winnowing": line_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_warc_revisits": warc.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLES = {
    "op2_chat_preferences": chat.SQL,
    "op10_line_winnowing": line_dedup.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_warc_revisits": warc.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
