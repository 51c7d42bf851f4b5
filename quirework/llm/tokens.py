"""Token ids from a public byte-level BPE vocabulary, loaded once per Python worker."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np

#: A parameter of every operator that tokenises; the file must be readable at this path on all executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """A tiktoken encoding of the ranks in ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_type(path: str) -> np.dtype:
    """The narrowest little-endian type that holds every id."""
    return np.dtype("<u2") if encoder(path).max_token_value < 1 << 16 else np.dtype("<u4")


def encode(text: str | None, path: str) -> np.ndarray:
    if not text:
        return np.zeros(0, id_type(path))
    kind = id_type(path)
    return np.frombuffer(array("H" if kind.itemsize == 2 else "I", encoder(path).encode_ordinary(text)), kind)


def decode(ids: np.ndarray, path: str) -> bytes:
    return encoder(path).decode_bytes(ids.tolist())
