"""Operators for preparing training text: deduplication, decontamination, quality, tokens, chats and web archives."""

from __future__ import annotations

import importlib

MODULES = (
    "exact_dedup",
    "chat_examples",
    "warc",
    "prefix_bpe",
    "huffman_ids",
    "line_crf",
    "template_decontam",
    "parity_join",
    "debruijn_dedup",
    "suffix_dedup",
    "token_alignment",
    "embedding_whitening",
    "balanced_shards",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"barloom.llm.{name}")


def queries() -> dict:
    """The opN_<name> query of every operator."""
    from barloom.llm.common import QUERIES

    _load()
    return dict(QUERIES)


def checks() -> dict[str, str]:
    """SQL giving the same rows, where SQL can express the operator."""
    from barloom.llm.common import CHECKS

    _load()
    return dict(CHECKS)
