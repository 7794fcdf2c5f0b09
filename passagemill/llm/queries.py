"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from passagemill.llm import chat, collocation, decontaminate, fingerprint, language, mixing, ngram_join, packing, pii, prefix_trie, quality, token_shards, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_packing": packing.op4_packing,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_language_id": language.op6_language_id,
    "op7_token_shards": token_shards.op7_token_shards,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_fingerprints": fingerprint.op10_fingerprints,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_collocations": collocation.op12_collocations,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op3_source_mixing": mixing.OP3_SQL,
    "op5_url_filters": url_filter.OP5_SQL,
    "op11_decontamination": decontaminate.OP11_SQL,
    "op12_collocations": collocation.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
