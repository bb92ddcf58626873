"""Objects of page-description files: values, parsing, writing.

Python values: None, bool, int, float, Name, bytes (strings), list, dict (keys without slash), Ref, Stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

from vellumspark.functions.text import DELIMITERS, SPACE

INT_MOST = 2**31 - 1
_BLANK, _DELIM = SPACE.encode(), frozenset(DELIMITERS.encode())
_SKIP = re.compile(rb"[\x00\t\n\x0c\r ]*+(?:%[^\r\n]*+[\x00\t\n\x0c\r ]*+)*+")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_REFERENCE = rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$)"
#: The next token in one match: 1 a name, 2 and 3 a reference, 4 a number, 5 a dictionary, 6 a list; else what else begins there.
_TOKEN = re.compile(_SKIP.pattern + rb"(?:/(" + _REGULAR.pattern + rb")|" + _REFERENCE + rb"|([+-]?(?:\d+\.?\d*|\.\d+))|(<<)|(\[))?")
#: In a dictionary: its end, or a key. In a list: its end.
_KEY = re.compile(_SKIP.pattern + rb"(?:(>>)|/(" + _REGULAR.pattern + rb"))?")
_CLOSE = re.compile(_SKIP.pattern + rb"(\])?")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_CODED = re.compile(rb"#([0-9A-Fa-f]{2})")
_PRINTABLE = bytes(range(32, 127))
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f"}


class SyntaxError_(ValueError):
    """Bytes that aren't an object."""


class Name(str):
    """A symbol; compares like its text."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    entries: dict[str, Any]
    raw: bytes = b""
    start: int = -1


@dataclass
class Parser:
    """Reads objects from bytes. decrypt: applied to strings; duplicates: keys that occurred twice."""

    data: bytes
    at: int = 0
    decrypt: Callable[[bytes], bytes] | None = None
    duplicates: int = field(default=0)

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def word(self) -> bytes:
        m = _REGULAR.match(self.data, self.at)
        self.at = m.end()
        return m[0]

    def expect(self, text: bytes) -> None:
        self.skip()
        if not self.data.startswith(text, self.at):
            raise SyntaxError_(f"expected {text.decode()} at {self.at}")
        self.at += len(text)

    def value(self) -> Any:
        m = _TOKEN.match(self.data, self.at)
        self.at = m.end()
        kind = m.lastindex
        if kind == 1:
            return parse_name(m[1])
        if kind == 3:
            return Ref(int(m[2]), int(m[3]))
        if kind == 4:
            if b"." in m[4]:
                return float(m[4])
            n = int(m[4])
            if abs(n) > INT_MOST + 1:
                raise SyntaxError_("an integer of more than 32 bits")
            return n
        if kind == 5:
            return self._dict()
        if kind == 6:
            return self._list()
        d, at = self.data, self.at
        c = d[at : at + 1]
        if c == b"(":
            return self._secret(self._literal())
        if c == b"<":
            end = d.find(b">", at)
            if end < 0:
                raise SyntaxError_("a hex string without end")
            self.at = end + 1
            digits = d[at + 1 : end].translate(None, _BLANK)
            try:
                return self._secret(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii")))
            except ValueError as e:
                raise SyntaxError_("a bad hex string") from e
        word = self.word()
        if word in (b"true", b"false"):
            return word == b"true"
        if word == b"null":
            return None
        raise SyntaxError_(f"no object at {at}: {word[:20]!r}")

    def _list(self) -> list:
        out = []
        while True:
            m = _CLOSE.match(self.data, self.at)
            self.at = m.end()
            if m[1]:
                return out
            out.append(self.value())

    def _secret(self, s: bytes) -> bytes:
        return self.decrypt(s) if self.decrypt else s

    def _dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while True:
            m = _KEY.match(self.data, self.at)
            self.at = m.end()
            if m.lastindex == 1:
                return out
            key = parse_name(m[2]) if m.lastindex else self.value()
            if not isinstance(key, Name):
                raise SyntaxError_("a key that isn't a name")
            v = self.value()
            self.duplicates += key in out
            out.pop(str(key), None)
            if v is not None:
                out[str(key)] = v

    def _literal(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at]
            at += 1
            if c == 0x5C:
                e = d[at : at + 1]
                at += 1
                if e in (b"\r", b"\n"):
                    at += e == b"\r" and d[at : at + 1] == b"\n"
                elif e and e in b"01234567":
                    m = _OCTAL.match(d, at - 1)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e:
                    out += _ESCAPES.get(e[0], e)
            elif c == 0x0D:
                at += d[at : at + 1] == b"\n"
                out.append(0x0A)
            else:
                depth += (c == 0x28) - (c == 0x29)
                if not depth:
                    self.at = at
                    return bytes(out)
                out.append(c)
        raise SyntaxError_("a string without end")


def parse(data: bytes) -> Any:
    """The one object that the bytes hold."""
    p = Parser(data)
    v = p.value()
    p.skip()
    if p.at != len(data):
        raise SyntaxError_("bytes after the object")
    return v


@lru_cache(4096)
def parse_name(word: bytes) -> Name:
    return Name(_CODED.sub(lambda m: bytes([int(m[1], 16)]), word).decode("utf-8", "surrogateescape"))


@lru_cache(4096)
def write_name(name: str) -> bytes:
    raw = name.encode("utf-8", "surrogateescape")
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in _DELIM and c != 0x23 else b"#%02x" % c for c in raw)


def write_string(s: bytes) -> bytes:
    """Literal if mostly printable, else hex in lines of 40 bytes."""
    if (len(s) - len(s.translate(None, _PRINTABLE))) * 4 >= len(s) * 3:
        return b"(" + s.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\0", b"\\000") + b")"
    return b"<" + b"\n".join(s[i : i + 40].hex().encode() for i in range(0, len(s), 40)) + b">"


def write_number(x: float) -> bytes:
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return (b"0" if text in ("", "-0") else text.encode())


def write(v: Any) -> bytes:
    """An object's bytes; a Stream's with its length entry and data."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return write_number(v)
    if isinstance(v, Name):
        return write_name(v)
    if isinstance(v, bytes):
        return write_string(v)
    if isinstance(v, list):
        return b"[" + b" ".join(write(x) for x in v) + b"]"
    if isinstance(v, dict):
        return b"<<" + b"\n".join(write_name(k) + b" " + write(x) for k, x in v.items() if x is not None) + b">>"
    if isinstance(v, Stream):
        return write(v.entries | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    raise TypeError(f"no object form of {type(v).__name__}")


def to_json(v: Any) -> Any:
    """Values as JSON: references {"$ref": [n, g]}, names {"$name": x}, strings {"$hex": x}."""
    if isinstance(v, Ref):
        return {"$ref": [v.num, v.gen]}
    if isinstance(v, Name):
        return {"$name": str(v).encode("utf-8", "surrogateescape").decode("utf-8", "replace")}
    if isinstance(v, bytes):
        return {"$hex": v.hex()}
    if isinstance(v, list):
        return [to_json(x) for x in v]
    if isinstance(v, dict):
        return {k.encode("utf-8", "surrogateescape").decode("utf-8", "replace"): to_json(x) for k, x in v.items()}
    if isinstance(v, Stream):
        return to_json(v.entries)
    return v


def from_json(v: Any) -> Any:
    if isinstance(v, dict):
        if "$ref" in v:
            return Ref(*map(int, v["$ref"]))
        if "$name" in v:
            return Name(v["$name"])
        if "$hex" in v:
            return bytes.fromhex(v["$hex"])
        return {k: from_json(x) for k, x in v.items()}
    return [from_json(x) for x in v] if isinstance(v, list) else v


def references(v: Any, path: str = "$") -> list[tuple[str, Ref]]:
    """All references inside a value with their places."""
    if isinstance(v, Ref):
        return [(path, v)]
    if isinstance(v, Stream):
        v = v.entries
    items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    return [x for k, y in items for x in references(y, f"{path}[{k}]" if isinstance(k, int) else f"{path}.{k}")]


def remap(v: Any, ids: Callable[[Ref], Any]) -> Any:
    """The value with each reference replaced."""
    if isinstance(v, Ref):
        return ids(v)
    if isinstance(v, Stream):
        return Stream(remap(v.entries, ids), v.raw)
    if isinstance(v, dict):
        return {k: remap(x, ids) for k, x in v.items()}
    return [remap(x, ids) for x in v] if isinstance(v, list) else v


def kind_of(v: Any) -> str:
    for t, name in ((type(None), "null"), (bool, "boolean"), (Ref, "reference"), (int, "integer"), (float, "real"), (Name, "name"), (bytes, "string"), (list, "array"), (dict, "dict"), (Stream, "stream")):
        if isinstance(v, t):
            return name
    raise TypeError(type(v).__name__)
