"""Byte-level BPE ids of whole texts, and the pieces that long documents are cut into.

Two libraries share the vocabulary.  The one of the rank file is several times
faster and takes the texts of long-settled Latin characters; texts with any
other character go to the tokenizer file, whose ids are the reference, as the
libraries may hold different versions of the Unicode classes.  So do texts with
the string of an added token, which gets that token's id, as the library has it.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

_UNSETTLED = re.compile("[^\x00-ɏ‐-…]")


class ByteTokens:
    """``tokenizer_file`` alone decides; ``ranks_file`` and ``pattern`` speed up most texts."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file and pattern:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers; the empty text has none."""
        if self.fast is not None and not _UNSETTLED.search(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first; none for 0."""
    first = n % most
    return ([(0, first)] if first else []) + [(s, most) for s in range(first, n, most)]
