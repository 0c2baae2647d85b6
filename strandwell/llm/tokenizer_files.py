"""Where the public tokenizer files are; every operator takes the path as a parameter."""

from __future__ import annotations

import public_tokenizers


def tokenizer_path(name: str) -> str:
    """The place of a tokenizer file, the same on every machine of the cluster."""
    return public_tokenizers.path(name)
