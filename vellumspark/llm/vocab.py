"""Tokenizers of installed libraries, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: the printable ones of Latin-1 as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Letters whose class and lower case are the same in every Unicode version in use.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e"
PLAIN = re.compile(f" ?[{LETTERS}]+")
SETTLED = re.compile(f"[\n -~{LETTERS}]*")
#: What the lower-casing vocabulary's file splits words by (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def library_encoder(path: str, words: bool = False) -> tuple[Callable[..., bytes], Callable[[str], list[str] | None]]:
    """Two functions: a string to the bytes of its ids (little-endian unsigned 32-bit), by the tokenizers library; a string to the matches it may be cut into.

    A single match of plain characters goes straight to the library's model (`plain` tells that split
    gave None, so it isn't asked again); other strings go through all of its steps and aren't cut.
    """
    t = library_tokenizer(path)
    merge, letters = t.model.tokenize, _byte_letters()
    plain, settled = PLAIN.fullmatch, SETTLED.fullmatch
    find = regex.compile(WORD_PATTERN if words else public_tokenizers.PATTERN).findall

    def split(x: str) -> list[str] | None:
        if plain(x):
            return None
        if not settled(x) or "<|" in x:
            return []
        return find(x.lower() if words else x)

    def encode(x: str, plain: bool = False) -> bytes:
        parts = None if plain else split(x)
        if parts is None or len(parts) == 1:
            if words:
                x = x.lower()
            y = x.encode().decode("latin-1").translate(letters) if not x.isascii() or "\n" in x else "\u0120" + x[1:] if x[:1] == " " else x
            return array("I", [k.id for k in merge(y)]).tobytes() if " " not in y else array("I", t.encode(x, add_special_tokens=False).ids).tobytes()
        return array("I", t.encode(x, add_special_tokens=False).ids).tobytes()

    return encode, split


@lru_cache(maxsize=4)
def library_units(path: str, words: bool, keep: int = 0):
    """The cached encoder over a vocabulary file; words: lower-cased BPE with word ends; keep: units of each generation that it keeps, if not its own number."""
    from vellumspark.llm.units import LibraryByteUnits, LibraryWordUnits

    return (LibraryWordUnits if words else LibraryByteUnits)(*library_encoder(path, words), **({"limit": keep} if keep else {}))


@lru_cache(maxsize=4)
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
