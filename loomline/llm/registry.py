"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomline.llm import boilerplate, chat, decontaminate, embeddings, langid, mixing, neardup, phrases, pii, sharding, tokens, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_mixing": mixing.op4_mixing,
    "op5_embedding_near_duplicates": embeddings.op5_embedding_near_duplicates,
    "op6_chat": chat.op6_chat,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_language": langid.op8_language,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_personal_data": pii.op10_personal_data,
    "op11_phrases": phrases.op11_phrases,
    "op12_html_text": boilerplate.op12_html_text,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op2_sharding": sharding.OP2_SQL,
    "op3_near_duplicates": neardup.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_chat": chat.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_html_text": boilerplate.OP12_SQL,
}
