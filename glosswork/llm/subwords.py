"""Subword ids of whole texts by a public byte-level tokenizer.

Two files hold one vocabulary: a tokenizers file and its ranks. The ranks are encoded several times faster; the
tokenizers file takes the texts that the fast way doesn't fit: those with the end marker's string in them, and those
with a run of so many characters without a break that merging by rank gets slow. Both give the same ids.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

_MARKER = "<|endoftext|>"
_LONG = 1000
_SPACES = " " * _LONG


class SubwordIds:
    def __init__(self, path: str | None = None, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @functools.cached_property
    def exact(self):
        """The tokenizers file's own encoder; it is large and rarely asked, so it is read when it is."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if _MARKER in text or (len(text) >= _LONG and (_SPACES in text or max(map(len, text.split(" "))) >= _LONG)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@functools.lru_cache(maxsize=2)
def shared(path: str | None = None, ranks: str | None = None) -> SubwordIds:
    """One for each worker process."""
    return SubwordIds(path, ranks)
