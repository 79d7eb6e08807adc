"""Queries of this subpackage."""

from chronoweft.llm import (  # noqa: F401
    alignment,
    decontamination, embeddings, licenses, lm, minhash, packing, pii, prefix_trie,
    quotes, tokens, top_inner, toxicity,
)
from chronoweft.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
