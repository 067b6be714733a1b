"""The subpackage's queries by name, with the SQL that checks them."""

from __future__ import annotations

from eventgraph.llm import chat, classifier, media, mixing, neardup, pieces, postings, pseudo, rollup, rules, runs, surrogates, trie

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_media": media.op3_media,
    "op4_quality_classifier": classifier.op4_quality_classifier,
    "op5_pii_surrogates": surrogates.op5_pii_surrogates,
    "op6_token_rollup": rollup.op6_token_rollup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_pseudo_likelihood": pseudo.op8_pseudo_likelihood,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_decontamination": postings.op11_decontamination,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_token_rollup": rollup.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_quality_rules": rules.OP9_SQL,
    "op11_decontamination": postings.OP11_SQL,
    "op12_periodic_runs": runs.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
