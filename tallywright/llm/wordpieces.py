"""Byte-level BPE encoding with a public vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64

import numpy as np

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: pre-tokeniser of the published byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256

_encoders: dict[str, ByteEncoder] = {}


class ByteEncoder:
    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the whole text; control strings are ordinary text."""
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes([int(i) for i in ids])


def byte_encoder(path: str | None = None) -> ByteEncoder:
    path = path or DEFAULT
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
