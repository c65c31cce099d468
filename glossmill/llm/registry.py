"""The registered queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from glossmill.llm import q_lookalikes, q_mixing, q_near_copies, q_neighbours, q_packing, q_pieces, q_scan_noise, q_sentences, q_spam_pages

_MODULES = [q_lookalikes, q_pieces, q_near_copies, q_sentences, q_scan_noise, q_neighbours, q_packing, q_mixing, q_spam_pages]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
