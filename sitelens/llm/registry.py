"""Registry of the training-data queries and their SQL twins."""

from __future__ import annotations

from sitelens.llm import (  # noqa: F401
    q_bpe,
    q_chat,
    q_exact,
    q_fingerprint,
    q_lang,
    q_lm,
    q_near,
    q_negatives,
    q_pack,
    q_suffix,
    q_toxic,
    q_trie,
    q_url,
)
from sitelens.llm.base import ORACLE, QUERIES  # noqa: F401
