"""The subpackage's registered queries and their SQL oracles, where SQL can express them."""

from __future__ import annotations

from manifoldry.llm import bpe, exact_dedup, minhash, packing, phrases, pieces, quality_rules, sharding, substring, token_counts, toxicity, url_filter, variants

QUERIES = {
    "op1_minhash": minhash.op1,
    "op2_token_counts": token_counts.op2,
    "op3_url_filter": url_filter.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_toxicity": toxicity.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_bpe": bpe.op7,
    "op8_packing": packing.op8,
    "op9_substring": substring.op9,
    "op10_sharding": sharding.op10,
    "url_rules": url_filter.url_rules,
    "op11_pieces": pieces.op11,
    "op12_phrases": phrases.op12,
    "op13_variants": variants.op13,
}
ORACLES = {
    "url_rules": url_filter.RULES_SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op12_phrases": phrases.SQL,
    "op13_variants": variants.SQL,
}
