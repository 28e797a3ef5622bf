"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_text, line_dedup, minhash, pii, prefix_trie, quality_rank, quality_rules, search, suffix_tree, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_pii_feistel": pii.op3_pii_feistel,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_quality_rank": quality_rank.op6_quality_rank,
    "op7_host_rules": quality_rules.op7_host_rules,
    "op8_warc": warc.op8_warc,
    "op9_bpe": bpe.op9_bpe,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_lm_scores": suffix_tree.op11_lm_scores,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_lexical_search": search.op13_lexical_search,
}

ORACLES = {
    "op4_line_dedup": line_dedup.SQL,
    "op7_host_rules": quality_rules.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_lexical_search": search.SQL,
}
