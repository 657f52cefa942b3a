"""Byte-level BPE ids from a public tokenizer file, quick enough for whole corpora.

The vocabulary's split pattern looks ahead only to part runs of white space. A text without two
white-space characters in a row is cut the same way by a pattern without look-ahead, which runs
as a plain automaton; the others take the vocabulary's own.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the white space of Unicode, as the split pattern takes it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
SPACES = re.compile(f"[{SPACE}]{{2}}")
#: White space that long is cut out before the pattern with look-ahead, which would go back over it.
LONG_SPACE = re.compile(f"[{SPACE}]{{1000,}}")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """encode(texts): the ids of all texts in a row, and where each text's begin. Special tokens'
    strings in a text are ordinary text; a null text has no ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        special = {t["content"] for t in vocab.get("added_tokens", [])}
        byte = _printable_bytes()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if t not in special}
        self.size = max(ranks.values()) + 1
        exact, plain = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, PLAIN))
        self.exact, self.plain, self.piece = exact.encode_ordinary, plain.encode_ordinary, exact._encode_single_piece

    def ids(self, text: str | None) -> list[int]:
        if not text or not SPACES.search(text):
            return self.plain(text) if text else []
        out, at = [], 0
        for m in LONG_SPACE.finditer(text):
            # The pattern takes a run of white space but for the last before a word as one piece.
            end = m.end() - (m.end() < len(text))
            out += self.exact(text[at : m.start()])
            out += self.piece(text[m.start() : end])
            at = end
        return out + self.exact(text[at:]) if at else self.exact(text)

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """end: an id that follows each text."""
        ids = [np.array(self.ids(t) + ([] if end is None else [end]), "<u4") for t in texts]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path)
