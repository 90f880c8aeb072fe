"""Words of a text for comparison, and hashes of runs of words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
import xxhash

#: A word divided at a line's end, and signs inside a word that show nothing.
_DIVIDED = re.compile(r"(?<=\w)[-‐‑⸗=¬]\s*[\r\n]\s*(?=\w)")
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_WORD = re.compile(r"[^\W_]+")
_ACCENT = regex.compile(r"\p{M}+")
#: Old letter forms that decomposition doesn't reach: u and v, i and j stood for each other.
_OLD = str.maketrans({"v": "u", "j": "i", "ꝛ": "r", "ꝑ": "p", "ꝓ": "p", "ꝙ": "q", "æ": "ae", "œ": "oe"})


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without accents and old letter forms; words divided at a line's end are
    one. The text is folded as a whole, which is several times faster than word by word."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_HIDDEN))
    if "\n" in text or "\r" in text:
        text = _DIVIDED.sub("", text)
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _WORD.findall(text.lower().translate(_OLD))


class _Known(dict):
    """Hashes of words met before; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Hasher:
    """64-bit hashes of words, and of runs of n words as a polynomial over them."""

    def __init__(self, keep: int = 500_000):
        self.known, self.keep = _Known(), keep

    def words(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))

    @staticmethod
    def runs(h: np.ndarray, n: int) -> np.ndarray:
        """Hash of h[i:i + n] for each i; empty if there are fewer."""
        if len(h) < n:
            return np.empty(0, np.int64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
        return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
