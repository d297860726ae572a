"""Queries of this subpackage, one per operator, and their oracle SQL."""

from __future__ import annotations

from tidemark.llm import bpe, exact_dedup, fertility, jaccard, langid, lexical, line_dedup, mixing, prefix_trie, quality_model, secrets, token_counts, token_files


def queries() -> dict:
    return {
        "op1_tokeniser_fertility": fertility.op1_tokeniser_fertility,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_token_files": token_files.op5_token_files,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_language_id": langid.op10_language_id,
        "op11_quality_model": quality_model.op11_quality_model,
        "op12_conversation_trie": prefix_trie.op12_conversation_trie,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_line_dedup": line_dedup.ORACLE,
        "op4_source_mixing": mixing.ORACLE,
        "op8_ngram_jaccard": jaccard.ORACLE,
        "op12_conversation_trie": prefix_trie.ORACLE,
        "op13_lexical_search": lexical.ORACLE,
    }
