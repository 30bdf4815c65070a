"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, factorisation, interaction, jaccard, langid, lexical, mixing, quality, secrets, sharding, substrings, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_repeated_substrings": substrings.op4_repeated_substrings,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_language_id": langid.op6_language_id,
    "op7_jump_shards": sharding.op7_jump_shards,
    "op8_poisson_mix": mixing.op8_poisson_mix,
    "op9_url_filter": urls.op9_url_filter,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_quality_classifier": factorisation.op12_quality_classifier,
    "op13_filter_audit": interaction.op13_filter_audit,
}

SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_repeated_substrings": substrings.OP4_SQL,
    "op7_jump_shards": sharding.OP7_SQL,
    "op8_poisson_mix": mixing.OP8_SQL,
    "op9_url_filter": urls.OP9_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op13_filter_audit": interaction.OP13_SQL,
}
