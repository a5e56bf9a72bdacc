"""Queries of this subpackage and the SQL that checks them, for the driver's entry module."""

from colloquy.llm import chat_format, exact_dedup, fingerprints, html_extract, mixing, near_dedup, packing, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_html_extract": html_extract.query,
    "op3_sharding": sharding.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_mixing": mixing.query,
    "op7_near_dedup": near_dedup.query,
    "op8_fingerprints": fingerprints.query,
    "op9_packing": packing.query,
    "op10_chat_format": chat_format.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
}
