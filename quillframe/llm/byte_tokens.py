"""Token ids of the public byte-level vocabulary, exactly as the tokenizers library gives them.

A text without the vocabulary's special token takes the same merges and the same split pattern
through tiktoken, whose ids agree on every code point (tests/llm/test_tokens.py) at four
times the speed. A text that holds a special token's string goes to the tokenizers library.
"""

from __future__ import annotations

import json

import numpy as np

from quillframe.llm.common import tokenizer_path

_LOADED: dict = {}


class ByteTokens:
    def __init__(self, path: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        at = tokenizer_path("byte_bpe_50k.json", path)
        spec = json.load(open(at, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.exact = Tokenizer.from_file(at)
        self.exact.no_padding()
        self.exact.no_truncation()
        letters = byte_letters()
        taken = set(self.special)
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in taken}
        # the split of the ByteLevel pre-tokeniser; a fixed value of the vocabulary
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids) -> str:
        return self.exact.decode([int(i) for i in ids], skip_special_tokens=False)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_tokens(path: str | None = None) -> ByteTokens:
    """The worker's one copy."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]
