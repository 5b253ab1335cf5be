"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import (byte_bpe, decontaminate, hard_negatives, html_extract, language_id, minhash_dedup, pii, prefix_trie,
               quality_rules, sentencepiece_codec, sharding, suffix_dedup, toxicity)


def queries() -> dict:
    return {
        "op1_pii": pii.query,
        "op2_toxicity": toxicity.query,
        "op3_html_extraction": html_extract.query,
        "op4_language_id": language_id.query,
        "op5_minhash_dedup": minhash_dedup.query,
        "op6_sharding": sharding.query,
        "op7_quality_rules": quality_rules.query,
        "op8_suffix_dedup": suffix_dedup.query,
        "op9_decontamination": decontaminate.query,
        "op10_sentencepiece": sentencepiece_codec.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_byte_bpe": byte_bpe.query,
    }


def more_queries() -> dict:
    """Queries beside the contract's, whose columns are fixed by their SQL."""
    return {"op9_proximity": decontaminate.proximity_query}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_minhash_dedup": minhash_dedup.SQL,
        "op7_quality_rules": quality_rules.SQL,
        "op8_suffix_dedup": suffix_dedup.SQL,
        "op9_decontamination": decontaminate.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
