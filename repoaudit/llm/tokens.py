"""Token ids of the byte-level tokenizer file, as the tokenizers library gives them.

The ``tiktoken`` ranks of the same vocabulary give the same ids some four times faster, so they are used for texts made only of characters
that both libraries class alike in every Unicode version: ASCII, Latin, Greek, Cyrillic and common punctuation. Any other text, and any that holds
the string of an added token (which the library gives that token's id), goes to the tokenizers library itself; a test compares the ids with a plain
``Tokenizer.from_file``.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Anything outside these ranges takes the tokenizers library.
_OTHER = "[^\\t-\\r\\x20-\\x7e\\xa1-\\u024f\\u0391-\\u03a1\\u03a3-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]"


class ByteBpe:
    def __init__(self, json_file: str, ranks_file: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_file)
        self.other = re.compile("|".join([_OTHER, *(re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values())]))
        self.fast = None
        if ranks_file and pattern:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def public(cls, name: str = "byte_bpe_50k") -> ByteBpe:
        import public_tokenizers as P

        return cls(P.path(f"{name}.json"), P.path(f"{name}.tiktoken"), P.PATTERN)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.fast is not None and not self.other.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
