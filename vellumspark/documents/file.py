"""One file: trailer, cross-reference sections, objects, object streams, encryption, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, NamedTuple

from vellumspark.codecs.chain import decode_chain
from vellumspark.crypto.security import Handler, SecurityError, open_handler
from vellumspark.documents.syntax import Name, Parser, Ref, Stream, SyntaxError_

HEAD_BYTES = TAIL_BYTES = 1024
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])")
_END = re.compile(rb"\s*endstream")
#: Attributes that pages take from their ancestors.
INHERITED = ("MediaBox", "CropBox", "Rotate", "Resources")


class FileError(ValueError):
    """A file that can't be read, or in strict mode one that breaks a rule."""


class Entry(NamedTuple):
    num: int
    type: str  # "n" in use, "f" free, "c" inside an object stream
    offset: int  # of the object, or the number of the stream that holds it
    gen: int  # or the place in that stream
    section: int  # 0 is the newest


def _beats(older: Entry, newer: Entry) -> bool:
    """Whether an entry of an older section holds against one of a newer one: a higher generation does, but not against one inside an object stream."""
    return "c" not in (older.type, newer.type) and older.gen > newer.gen


@dataclass
class Page:
    ref: Ref
    number: int
    entries: dict[str, Any]
    inherited: dict[str, Any]


def filters_of(entries: dict[str, Any], fetch=lambda x: x) -> tuple[list[str], list[dict]]:
    """Names and parameters of a stream's filters."""
    names, params = fetch(entries.get("Filter")), fetch(entries.get("DecodeParms"))
    names = names if isinstance(names, list) else [] if names is None else [names]
    params = params if isinstance(params, list) else [] if params is None else [params]
    params = [{k: fetch(v) for k, v in (fetch(p) or {}).items()} for p in params]
    return [str(fetch(n)) for n in names], params + [{}] * (len(names) - len(params))


class File:
    """strict: entry counts and required page attributes are checked; otherwise problems are listed in `problems`."""

    def __init__(self, data: bytes, password: bytes = b"", strict: bool = False):
        self.data, self.strict = data, strict
        self.problems: list[str] = []
        self.held: dict[int, dict[int, Any]] = {}
        self.leaves: list[Page] | None = None
        head = re.search(rb"%PDF-(\d+\.\d+)", data[:HEAD_BYTES])
        if not head:
            raise FileError("no header")
        self.version, self.shift = head[1].decode(), head.start()
        tail = data[-TAIL_BYTES:]
        m = list(re.finditer(rb"startxref\s+(\d+)\s+%%EOF", tail))
        if not m:
            raise FileError("no startxref")
        self.start = int(m[-1][1])
        self.trailer: dict[str, Any] = {}
        self.entries: dict[int, Entry] = {}
        self.sections: list[Entry] = []
        self.handler: Handler | None = None
        self.secret: Ref | None = None
        self._sections()
        size = self.trailer.get("Size")
        if self.entries and size != max(self.entries) + 1:
            self._problem(f"Size is {size}, the highest object {max(self.entries)}")
        if "Encrypt" in self.trailer:
            e = self.trailer["Encrypt"]
            self.secret = e if isinstance(e, Ref) else None
            ids = self.fetch(self.trailer.get("ID")) or [b""]
            e = {k: self.fetch(v) for k, v in self.fetch(e).items()}
            self.handler = open_handler(e, ids[0], password)

    def _problem(self, text: str) -> None:
        if self.strict:
            raise FileError(text)
        self.problems.append(text)

    def _sections(self) -> None:
        at: int | None = self.start
        seen: set[int] = set()
        while at is not None:
            if at in seen:
                raise FileError("cross-reference sections form a cycle")
            seen.add(at)
            p = Parser(self.data, at + self.shift)
            p.skip()
            found, trailer = self._table(p, len(seen) - 1) if self.data.startswith(b"xref", p.at) else self._xref_stream(p, len(seen) - 1)
            self.sections += found
            for e in found:
                if e.num not in self.entries or _beats(e, self.entries[e.num]):
                    self.entries[e.num] = e
            self.trailer = self.trailer or trailer  # the newest one alone: what it dropped stays dropped
            at = trailer.get("Prev")

    def _table(self, p: Parser, section: int) -> tuple[list[Entry], dict[str, Any]]:
        p.at += 4
        out: list[Entry] = []
        while True:
            p.skip()
            if self.data.startswith(b"trailer", p.at):
                p.at += 7
                return out, p.value()
            first, n = p.value(), p.value()
            p.skip()
            for i in range(n):
                m = _ENTRY.match(self.data, p.at)
                if not m:
                    raise FileError("a bad cross-reference entry")
                out.append(Entry(first + i, m[3].decode(), int(m[1]), int(m[2]), section))
                p.at += 20

    def _xref_stream(self, p: Parser, section: int) -> tuple[list[Entry], dict[str, Any]]:
        _, s = self._object_at(p, None)
        if not isinstance(s, Stream) or s.entries.get("Type") != "XRef":
            raise FileError("no cross-reference section")
        d = s.entries
        names, params = filters_of(d)
        body = decode_chain(s.raw, names, params).data
        w = d["W"]
        index = d.get("Index") or [0, d["Size"]]
        out, at = [], 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for i in range(n):
                f = []
                for k in w:
                    f.append(int.from_bytes(body[at : at + k], "big"))
                    at += k
                kind = f[0] if w[0] else 1
                if kind in (0, 1, 2):
                    out.append(Entry(first + i, "fnc"[kind], f[1], f[2] if len(f) > 2 else 0, section))
        return out, {k: v for k, v in d.items() if k not in ("Length", "Filter", "DecodeParms", "W", "Index", "Type")}

    def _object_at(self, p: Parser, decrypt_for: Ref | None) -> tuple[Ref, Any]:
        num, gen = p.value(), p.value()
        p.expect(b"obj")
        ref = Ref(num, gen)
        h = self.handler
        if h and decrypt_for and ref != self.secret:
            p.decrypt = lambda s: h.open(s, num, gen, "string")
        v = p.value()
        p.skip()
        if isinstance(v, dict) and self.data.startswith(b"stream", p.at):
            at = p.at + 6
            at += 2 if self.data.startswith(b"\r\n", at) else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
            n = v.get("Length")
            n = self.fetch(n) if isinstance(n, Ref) else n
            if not isinstance(n, int) or not _END.match(self.data, at + n):
                end = self.data.find(b"endstream", at)
                self._problem(f"object {num}: bad stream length")
                n = max(0, (end if end >= 0 else len(self.data)) - at)
            raw = self.data[at : at + n]
            if h and decrypt_for and v.get("Type") != "XRef" and (h.encrypt_metadata or v.get("Type") != "Metadata"):
                raw = h.open(raw, num, gen, "stream")
            v = Stream(v, raw, at)
        return ref, v

    def object(self, ref: Ref) -> Any:
        """The object, or None if it is missing, free, or of another generation."""
        e = self.entries.get(ref.num)
        if e is None or e.type == "f":
            return None
        if e.type == "c":
            return self._container(e.offset).get(ref.num) if ref.gen == 0 else None
        if e.gen != ref.gen:
            return None
        found, v = self._object_at(Parser(self.data, e.offset + self.shift), ref)
        if found.num != ref.num:
            self._problem(f"object {ref.num}: the table points to {found.num}")
            return None
        return v

    def _container(self, num: int) -> dict[int, Any]:
        """All objects of an object stream, read once."""
        if num not in self.held:
            s = self.object(Ref(num, 0))
            out: dict[int, Any] = {}
            if isinstance(s, Stream):
                data = self.decode(s).data
                p, n, first = Parser(data), self.fetch(s.entries["N"]), self.fetch(s.entries["First"])
                places = [(p.value(), p.value()) for _ in range(n)]
                for i, (k, at) in enumerate(places):
                    e = self.entries.get(k)
                    if e and e.type == "c" and e.offset == num and e.gen == i:
                        out[k] = Parser(data, first + at).value()
            self.held[num] = out
        return self.held[num]

    def fetch(self, v: Any) -> Any:
        """Follows references to a value; a cycle of references is None."""
        seen = set()
        while isinstance(v, Ref):
            if v in seen:
                return None
            seen.add(v)
            v = self.object(v)
        return v

    def decode(self, s: Stream):
        return decode_chain(s.raw, *filters_of(s.entries, self.fetch))

    def refs(self) -> list[Ref]:
        return [Ref(e.num, 0 if e.type == "c" else e.gen) for e in sorted(self.entries.values()) if e.type != "f"]

    @property
    def root(self) -> dict[str, Any]:
        r = self.fetch(self.trailer.get("Root"))
        if not isinstance(r, dict):
            raise FileError("no catalog")
        return r

    def pages(self) -> list[Page]:
        """Leaves of the page tree in order, with what they inherit. Parents and counts are checked. The tree is walked once."""
        if self.leaves is None:
            self.leaves = self._walked()
        return self.leaves

    def _walked(self) -> list[Page]:
        out: list[Page] = []
        seen: set[Ref] = set()

        def walk(ref: Ref, parent: Ref | None, inherited: dict[str, Any]) -> int:
            if ref in seen:
                self._problem(f"page node {ref.num} occurs twice")
                return 0
            seen.add(ref)
            d = self.fetch(ref)
            if not isinstance(d, dict):
                self._problem(f"page node {ref.num} is missing")
                return 0
            if d.get("Parent") != parent:
                self._problem(f"page node {ref.num}: wrong parent")
            inherited = inherited | {k: d[k] for k in INHERITED if k in d}
            if d.get("Type") == "Pages" or "Kids" in d:
                n = sum(walk(k, ref, inherited) for k in self.fetch(d.get("Kids")) or [])
                if self.fetch(d.get("Count")) != n:
                    self._problem(f"page node {ref.num}: Count isn't {n}")
                return n
            for k in ("MediaBox", "Resources"):
                if k not in inherited:
                    self._problem(f"page {ref.num}: no {k}")
            out.append(Page(ref, len(out) + 1, d, {k: self.fetch(v) if k != "Resources" else v for k, v in inherited.items()}))
            return 1

        top = self.root.get("Pages")
        if isinstance(top, Ref):
            walk(top, None, {})
        return out


__all__ = ["Entry", "File", "FileError", "Name", "Page", "SecurityError", "SyntaxError_"]
