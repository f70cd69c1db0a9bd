"""The registered queries and their SQL twins."""

from __future__ import annotations

from orrery.llm import q_chaining, q_clustering, q_context_mixing, q_conversations, q_decontamination, q_language, q_mixing, q_mpeg_audio, q_sharding, q_simhash, q_sstable, q_suffix_dedup, q_toxicity

_MODULES = (q_mixing, q_sharding, q_decontamination, q_language, q_simhash, q_sstable, q_mpeg_audio, q_chaining, q_context_mixing, q_suffix_dedup, q_clustering, q_conversations, q_toxicity)
LLM_QUERIES: dict = {}
LLM_ORACLE: dict = {}
for _m in _MODULES:
    LLM_QUERIES[_m.NAME] = _m.query
    if getattr(_m, "SQL", None):
        LLM_ORACLE[_m.NAME] = _m.SQL
