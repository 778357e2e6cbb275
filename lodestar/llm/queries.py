"""Queries of the training-data operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from lodestar.llm import op1_html, op10_embeddings, op11_codes, op12_periods, op13_tokens, op2_decontaminate, op3_toxicity, op4_suffixes, op5_quality, op6_substrings, op7_near_duplicates, op8_chat, op9_mix

QUERIES = {
    "op1_html": op1_html.op1_html,
    "op2_decontaminate": op2_decontaminate.op2_decontaminate,
    "op3_toxicity": op3_toxicity.op3_toxicity,
    "op4_suffixes": op4_suffixes.op4_suffixes,
    "op5_quality": op5_quality.op5_quality,
    "op6_substrings": op6_substrings.op6_substrings,
    "op7_near_duplicates": op7_near_duplicates.op7_near_duplicates,
    "op8_chat_rotation": op8_chat.op8_chat_rotation,
    "op9_mix": op9_mix.op9_mix,
    "op10_embeddings": op10_embeddings.op10_embeddings,
    "op11_codes": op11_codes.op11_codes,
    "op12_periods": op12_periods.op12_periods,
    "op13_token_counts": op13_tokens.op13_token_counts,
}
SQL = {"op10_embeddings": op10_embeddings.SQL, "op11_codes": op11_codes.SQL, "op2_decontaminate": op2_decontaminate.SQL, "op4_suffixes": op4_suffixes.SQL, "op6_substrings": op6_substrings.SQL, "op8_chat_rotation": op8_chat.SQL, "op9_mix": op9_mix.SQL}
