"""Whole-text encoding through bounded caches of short units.

Both vocabularies split a text before they merge, and no match of their patterns spans the places
where this module cuts. A unit's ids are therefore the same alone and inside its text, and each
distinct unit of a task's block needs encoding only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space after white space starts no unit of its own: the pattern may take both together.
RISKY = re.compile(r"\s ")
BOUNDARY = re.compile(r"(?<=\S)(?= )")
#: Longer units are encoded but not kept.
KEEP_LEN = 96


class Kept(dict):
    """A bounded map that makes what it lacks: what is used again moves to the younger of two generations."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, k):
        v = self.old.get(k)
        if v is None:
            v = self.make(k)
        if len(k) <= KEEP_LEN:
            self[k] = v
        return v

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class LibraryByteUnits:
    """Texts to ids (little-endian unsigned 32-bit) for byte-level BPE that keeps white space, a unit at a time: `encode` gives the bytes of a string's ids, `split` the matches in it, if any."""

    def __init__(self, encode: Callable[..., bytes], split: Callable[[str], list[str] | None], limit: int = 500_000):
        self.one, self.split = encode, split
        self.raw = Kept(self._raw, limit // 5)
        self.spaced = Kept(lambda k: self._raw(" " + k), limit)

    def _raw(self, unit: str) -> bytes:
        parts = self.split(unit)
        if not parts or len(parts) == 1:
            return self.one(unit, parts is None)
        return b"".join([self.spaced[p[1:]] if p[:1] == " " and len(p) > 1 else self.raw[p] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        self.raw.turn()
        self.spaced.turn()
        raw, spaced, out = self.raw.__getitem__, self.spaced.__getitem__, []
        for t in texts:
            if RISKY.search(t):
                out.append(b"".join(map(raw, BOUNDARY.split(t))))
            else:
                first, *rest = t.split(" ")
                out.append(raw(first) + b"".join(map(spaced, rest)))
        return out


class LibraryWordUnits:
    """The same for BPE with word ends that lower-cases and drops white space."""

    def __init__(self, encode: Callable[..., bytes], split: Callable[[str], list[str] | None], limit: int = 500_000):
        self.one, self.split = encode, split
        self.words = Kept(self._word, limit)

    def _word(self, k: bytes) -> bytes:
        x = k.decode()
        parts = self.split(x)
        if not parts or len(parts) == 1:
            return self.one(x, parts is None)
        return b"".join([self.words[p.encode()] for p in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        self.words.turn()
        word, out = self.words.__getitem__, []
        for t in texts:
            b = t.encode()
            out.append(b"".join(map(word, b.split() if b"<|" in b else b.lower().split())))
        return out
