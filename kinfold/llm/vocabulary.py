"""Places and contents of tokenizer files, read once per Python worker."""

from __future__ import annotations

import base64
import functools
import os


def place(name: str) -> str:
    """An absolute path stays; another name is a file of the installed tokenizer package."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def ranks(name: str) -> dict[bytes, int]:
    with open(place(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@functools.lru_cache(maxsize=4)
def byte_encoding(name: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})
