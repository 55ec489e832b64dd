"""Token ids of texts by the tokenizer library, for the operators that count or store tokens.

The library's own splitting is the slow part, so texts are split here and every different piece is encoded once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

from weirworks.llm.bpe import Splitter, load_ranks

#: Pieces that a worker remembers.
MEMO = 800_000


class TokenEncoder(dict):
    """Ids of a text as little-endian integers of ``width`` bytes; a dictionary of the pieces met so far."""

    def __init__(self, ranks_path: str, pattern: str, width: int = 2):
        super().__init__()
        ranks = load_ranks(ranks_path)
        self.kind = np.dtype(f"<u{width}")
        if ranks and max(ranks.values()) > np.iinfo(self.kind).max:
            raise ValueError(f"ids of this vocabulary need more than {width} bytes")
        self.split = Splitter(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._table = [rank.to_bytes(width, "little") for rank in range(max(ranks.values(), default=-1) + 1)]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = b"".join(map(self._table.__getitem__, self.library.encode_ordinary(piece)))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""


@lru_cache(maxsize=4)
def token_encoder(ranks_path: str, pattern: str, width: int = 2) -> TokenEncoder:
    """One encoder for each worker process and tokenizer."""
    return TokenEncoder(ranks_path, pattern, width)
