"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from gridseries.llm import chat, decontaminate, exact_dedup, jaccard_join, language_id, lexical_search, line_dedup, mixing, pii, quality, substring_dedup, token_alignment, toxicity

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_quality_rules": quality.op5,
    "op6_toxicity": toxicity.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_pii_surrogates": pii.op8,
    "op9_chat_format": chat.op9,
    "op10_mix_sources": mixing.op10,
    "op11_exact_dedup": exact_dedup.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_token_alignment": token_alignment.op13,
}

ORACLE_SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
