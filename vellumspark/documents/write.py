"""Files from objects: numbering, page trees, copies between files."""

from __future__ import annotations

import hashlib
from typing import Any

from vellumspark.codecs.chain import encode_chain
from vellumspark.crypto.security import new_handler
from vellumspark.documents.file import File
from vellumspark.documents.syntax import Name, Ref, Stream, remap, write

#: Page entries that a copy doesn't follow.
CUT = ("Type", "Parent", "MediaBox", "CropBox", "Resources", "Contents", "Rotate", "B", "StructParents")
ROTATIONS = (0, 90, 180, 270)


def stream(data: bytes, filters: list[str] | None = None, params: list[dict | None] | None = None, **entries: Any) -> Stream:
    """A stream whose data is encoded by a chain of filters; parameters that are empty aren't written."""
    filters = filters or []
    e: dict[str, Any] = dict(entries)
    if filters:
        e["Filter"] = Name(filters[0]) if len(filters) == 1 else [Name(f) for f in filters]
    if params and any(params):
        e["DecodeParms"] = params[0] if len(filters) == 1 else [p or None for p in params]
    return Stream(e, encode_chain(data, filters, params))


class Writer:
    """Collects objects and pages; bytes() gives the file."""

    def __init__(self, version: str = "1.4"):
        self.version = version
        self.objects: dict[int, Any] = {}
        self.info: Ref | None = None
        self.kids: list[Ref] = []
        self.tree = self.reserve()

    def reserve(self) -> Ref:
        n = len(self.objects) + 1
        self.objects[n] = None
        return Ref(n, 0)

    def put(self, ref: Ref, v: Any) -> Ref:
        self.objects[ref.num] = v
        return ref

    def add(self, v: Any) -> Ref:
        return self.put(self.reserve(), v)

    def page(self, media_box: list[float], contents: list[Ref] | None = None, resources: Any = None, rotate: int = 0, crop_box: list[float] | None = None, **more: Any) -> Ref:
        if rotate % 360 not in ROTATIONS:
            raise ValueError("pages turn by 0, 90, 180 or 270")
        d: dict[str, Any] = {"Type": Name("Page"), "Parent": self.tree, "MediaBox": media_box, "Resources": resources if resources is not None else {}}
        if crop_box:
            d["CropBox"] = crop_box
        if rotate % 360:
            d["Rotate"] = rotate % 360
        if contents:
            d["Contents"] = contents[0] if len(contents) == 1 else contents
        ref = self.add(d | more)
        self.kids.append(ref)
        return ref

    def set_rotation(self, page: Ref, rotate: int) -> None:
        if rotate not in ROTATIONS:
            raise ValueError("pages turn by 0, 90, 180 or 270")
        self.objects[page.num]["Rotate"] = rotate

    def set_box(self, page: Ref, box: list[float], name: str = "MediaBox") -> None:
        self.objects[page.num][name] = box

    def add_content(self, page: Ref, content: Ref) -> None:
        d = self.objects[page.num]
        held = d.get("Contents")
        d["Contents"] = content if held is None else [*(held if isinstance(held, list) else [held]), content]

    def add_resource(self, page: Ref, category: str, value: Any, name: str | None = None) -> None:
        """A named resource goes into the category's dictionary, one without a name into its list."""
        all_ = self.objects[page.num]["Resources"]
        if name is None:
            all_.setdefault(category, []).append(value if isinstance(value, Ref) else Name(value))
        else:
            all_.setdefault(category, {})[name] = value

    def copy(self, source: File, ref: Ref, done: dict[Ref, Any]) -> Any:
        """A reference in this file to a copy of all that `ref` reaches, shared through `done`; referenced scalars become values. No recursion, so cycles and depth don't matter."""
        todo: list[Ref] = []

        def place(r: Ref) -> Any:
            if r not in done:
                v = source.fetch(r)
                if v is None or isinstance(v, (bool, int, float, Name)):
                    done[r] = v
                else:
                    done[r] = self.reserve()
                    todo.append(r)
            return done[r]

        out = place(ref)
        while todo:
            r = todo.pop()
            self.put(done[r], remap(source.fetch(r), place))
        return out

    def copy_page(self, source: File, number: int, done: dict[Ref, Any]) -> Ref:
        """Page `number` (from 1) of another file. Its stream data is copied as it is."""
        pages = source.pages()
        if not 1 <= number <= len(pages):
            raise IndexError(f"page {number} of {len(pages)}")
        p = pages[number - 1]
        new = self.reserve()
        done[p.ref] = new  # references back to the page stay inside the copy
        move = lambda v: remap(v, lambda r: self.copy(source, r, done))
        d: dict[str, Any] = {"Type": Name("Page"), "Parent": self.tree}
        for k in ("MediaBox", "CropBox", "Rotate", "Resources"):
            if k in p.inherited:
                d[k] = move(p.inherited[k])
        if "Contents" in p.entries:
            d["Contents"] = move(p.entries["Contents"])
        self.put(new, d | {k: move(v) for k, v in p.entries.items() if k not in CUT})
        self.kids.append(new)
        return new

    def compact_bytes(self) -> bytes:
        """The file with all objects that aren't streams inside one object stream, behind a cross-reference stream."""
        catalog = self.add({"Type": Name("Catalog"), "Pages": self.tree})
        self.put(self.tree, {"Type": Name("Pages"), "Kids": list(self.kids), "Count": len(self.kids)})
        inside = [n for n, v in sorted(self.objects.items()) if not isinstance(v, Stream)]
        bodies = [write(self.objects[n]) for n in inside]
        starts = [0]
        for b in bodies:
            starts.append(starts[-1] + len(b) + 1)
        head = b" ".join(b"%d %d" % x for x in zip(inside, starts, strict=False)) + b" "
        whole = {n: v for n, v in self.objects.items() if isinstance(v, Stream)}
        held = max(self.objects) + 1
        whole[held] = stream(head + b" ".join(bodies), ["FlateDecode"], Type=Name("ObjStm"), N=len(inside), First=len(head))
        out, entries = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % b"1.5"), {0: (0, 0, 65535)}
        entries |= {n: (2, held, i) for i, n in enumerate(inside)}
        for n in sorted(whole):
            entries[n] = (1, len(out), 0)
            out += b"%d 0 obj\n" % n + write(whole[n]) + b"\nendobj\n"
        at, last = len(out), held + 1
        entries[last] = (1, at, 0)
        rows = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(4, "big") for _, (a, b, c) in sorted(entries.items()))
        more = {"Info": self.info} if self.info else {}
        table = stream(rows, ["FlateDecode"], [{"Predictor": 12, "Columns": 9}], Type=Name("XRef"), W=[1, 4, 4], Size=last + 1, Root=catalog, **more)
        return bytes(out + b"%d 0 obj\n" % last + write(table) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at)

    def bytes(self, user: bytes | None = None, owner: bytes = b"", revision: int = 3, aes: bool = False) -> bytes:
        """The file; encrypted if a user password (maybe empty) is given."""
        catalog = self.add({"Type": Name("Catalog"), "Pages": self.tree})
        self.put(self.tree, {"Type": Name("Pages"), "Kids": list(self.kids), "Count": len(self.kids)})
        plain = {n: write(v) for n, v in self.objects.items()}
        doc_id = hashlib.md5(b"".join(plain.values())).digest()
        trailer: dict[str, Any] = {"Root": catalog, "ID": [doc_id, doc_id]}
        if self.info:
            trailer["Info"] = self.info
        if user is not None:
            handler, e = new_handler(user, owner, revision, doc_id, aes=aes)
            plain = {n: write(_sealed(v, handler, n)) for n, v in self.objects.items()}
            trailer["Encrypt"] = self.add(e)
            plain[trailer["Encrypt"].num] = write(e)
        out = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % self.version.encode())
        offsets = []
        for n in sorted(plain):
            offsets.append(len(out))
            out += b"%d 0 obj\n" % n + plain[n] + b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % x for x in offsets)
        out += b"trailer\n" + write({"Size": len(offsets) + 1} | trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at
        return bytes(out)


def _sealed(v: Any, h, n: int) -> Any:
    if isinstance(v, bytes):
        return h.seal(v, n, 0, "string")
    if isinstance(v, Stream):
        return Stream({k: _sealed(x, h, n) for k, x in v.entries.items()}, h.seal(v.raw, n, 0, "stream"))
    if isinstance(v, dict):
        return {k: _sealed(x, h, n) for k, x in v.items()}
    return [_sealed(x, h, n) for x in v] if isinstance(v, list) else v


def select_pages(data: bytes, start: int, length: int, password: bytes = b"") -> bytes:
    """A file of pages start .. start + length - 1 (from 1); what they share is copied once."""
    source, w, done = File(data, password), Writer(), {}
    for n in range(start, start + length):
        w.copy_page(source, n, done)
    return w.bytes()


def merge(files: list[bytes], password: bytes = b"") -> bytes:
    """All pages of all files in order."""
    w = Writer()
    for data in files:
        source, done = File(data, password), {}
        for p in source.pages():
            w.copy_page(source, p.number, done)
    return w.bytes()
