"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from tallyspark.llm import alignment, byte_bpe, exact_dedup, licenses, merkle, mixing, near_dedup, neighbours, quality, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_nearest": neighbours.op8_nearest,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": mixing.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
}
