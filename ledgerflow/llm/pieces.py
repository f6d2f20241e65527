"""Cutting texts by the byte-level BPE pattern, and the bounded store of pieces already encoded."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import public_tokenizers
import regex

# The public pattern spelt out for the first 256 code points, whose letters, numbers and white space are fixed.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN_1 = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text into the pattern's matches; texts of the first 256 code points take a faster automaton for the public pattern."""
    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return LATIN_1.findall(text)

    return cut


class PieceStore:
    """Encoded pieces as little-endian unsigned 32-bit ids, in two generations.

    When the young generation is full it becomes the old one, and what is used
    afterwards is carried over; so memory is bounded whatever the corpus, and
    frequent pieces stay.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], Iterable[bytes]], most: int = 600_000):
        self.cut, self.encode, self.most = cutter(pattern), encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A piece is looked up once; only texts with new pieces are gone through again."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        get, out, again = self.young.get, [], []
        for k, c in enumerate(map(self.cut, texts)):
            found = list(map(get, c))
            try:
                out.append(b"".join(found))
            except TypeError:  # a piece that is not in the store
                out.append(b"")
                again.append((k, c, found))
        if again:
            missing = {p for _, c, found in again for p, x in zip(c, found) if x is None}
            kept = missing.intersection(self.old)
            self.young.update(zip(kept, map(self.old.__getitem__, kept)))
            new = list(missing.difference(kept))
            self.young.update(zip(new, self.encode(new)))
            for k, c, found in again:
                out[k] = b"".join([get(p) if x is None else x for p, x in zip(c, found)])
        return out
