"""Queries of the operators on the given tables, and the SQL that checks them."""

from __future__ import annotations

from ledgerprep.llm import (
    q_bpe, q_chat, q_decontaminate, q_divergence, q_html, q_jaccard, q_language, q_mixing, q_repeats, q_tokens, q_topk, q_trie,
)

_MODULES = (
    q_repeats, q_decontaminate, q_html, q_jaccard, q_language, q_mixing, q_topk, q_tokens, q_chat, q_bpe, q_trie, q_divergence,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
