"""Tokenizer access shared by the operators on token ids: whole texts to ids, each token's bytes."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import tiktoken

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files of public tokenizers are; the path is a parameter everywhere.
VOCABULARY = os.environ.get("SILTSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file, and the number of bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("siltstone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin.  A null text has none."""
    own, _ = encoder(path)
    ids = [own.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)).astype(np.int32), first
