"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from docketlake.llm import chat, decontamination, jaccard_join, mixing, prefix_trie, private_data, quality_crf, quality_rules, secrets, sharding, simhash_dedup, toxicity, vector_codes

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_private_data": private_data.op3_private_data,
    "op4_simhash_near_dedup": simhash_dedup.op4_simhash_near_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_quality_crf": quality_crf.op6_quality_crf,
    "op7_sharding": sharding.op7_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_quality_rules": quality_rules.RULES_SQL, "op5_chat_formatting": chat.CHAT_SQL, "op11_vector_codes": vector_codes.CODES_SQL}
