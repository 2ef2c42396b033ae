"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fuzzy_prints, licenses, line_dedup, minhash, mixing, prefix_trie, quality, sharding, substring_dedup, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_minhash": minhash.op2_minhash,
    "op3_licenses": licenses.op3_licenses,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_fuzzy_prints": fuzzy_prints.op13_fuzzy_prints,
}

SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_minhash": minhash.SQL,
    "op3_licenses": licenses.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_suffix_dedup": suffix_dedup.SQL,
    "op10_mixing": mixing.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
