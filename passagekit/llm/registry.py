"""The queries of this subpackage, and the SQL for those that SQL can express (none can)."""

from __future__ import annotations

from passagekit.llm import bpe, fingerprint, language, lines, neighbours, packing, pii, quality, secrets, simhash

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_candidate_boosting": pii.op2_candidate_boosting,
    "op3_ftrl_quality": quality.op3_ftrl_quality,
    "op4_multiset_fingerprint": fingerprint.op4_multiset_fingerprint,
    "op5_one_bit_codes": neighbours.op5_one_bit_codes,
    "op6_fuzzy_line_dedup": lines.op6_fuzzy_line_dedup,
    "op7_randomness_battery": secrets.op7_randomness_battery,
    "op8_bpe_automaton": bpe.op8_bpe_automaton,
    "op9_hierarchical_language": language.op9_hierarchical_language,
    "op10_pattern_packing": packing.op10_pattern_packing,
}
ORACLE_SQL: dict[str, str] = {}
