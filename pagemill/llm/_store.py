"""Where intermediate tables and public vocabularies are."""

from __future__ import annotations

from pagemill.sources.shared import Scratch, clean, release, shared_dir, stored

__all__ = ["Scratch", "clean", "release", "shared_dir", "stored", "tokenizer_path"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary file (a default; a parameter everywhere)."""
    import public_tokenizers

    return public_tokenizers.path(name)
