"""Public byte-level BPE vocabularies: a rank file with one base64 token and its rank a line."""

from __future__ import annotations

import base64
import hashlib

#: Where the rank files lie; every operator takes another path as a parameter.
TOKENIZERS = "/opt/tokenizers"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: How a text falls into words before merging: the published pattern of byte-level BPE with 50k merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def fast_encoding(path: str = RANKS):
    import tiktoken

    return tiktoken.Encoding(hashlib.md5(path.encode()).hexdigest(), pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
