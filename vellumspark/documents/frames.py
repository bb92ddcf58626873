"""Files as DataFrames: a pass of Arrow batches over binary rows, then ordinary plans."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.codecs.columns import decode_stream
from vellumspark.documents.file import File, Page, filters_of
from vellumspark.documents.syntax import Name, Ref, Stream, kind_of, references, to_json
from vellumspark.documents.write import Writer, merge, select_pages, stream
from vellumspark.operators.base import dealt, release, small_batches

OBJECTS = "doc_id string, obj_num int, gen int, kind string, value_json string, filters array<string>, params_json string, start long, raw binary, space_json string, edges array<struct<path:string,num:int,gen:int>>, corrupt_reason string"
XREF = "doc_id string, obj_num int, type string, off long, gen int, section int, corrupt_reason string"
PAGES = "doc_id string, page_no int, num int, gen int, mediabox array<float>, cropbox array<float>, rotate int, resources_json string, contents array<struct<num:int,gen:int>>, entries_json string, corrupt_reason string"
EDGES = "doc_id string, src_num int, src_gen int, path string, dst_num int, dst_gen int, corrupt_reason string"
CONTENTS = "doc_id string, page_no int, place int, obj_num int, gen int, data binary, left array<string>, reason string, encrypted boolean, corrupt_reason string"
#: Rows, and bytes of files, whose rows leave at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 1 << 20
INFO = "doc_id string, version string, pages int, objects int, encrypted boolean, trailer_json string, root_json string, info_json string, corrupt_reason string"


def files(spark, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """doc_id (the path), content: one row per file."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return r.load(path).select(F.col("path").alias("doc_id"), "content")


def _scan(docs: DataFrame, schema: str, rows: Callable[[str, File], Iterator[tuple]], password: bytes) -> DataFrame:
    """One row or more per file; a file that can't be read gives one row of nulls with the reason."""
    fields = docs.sparkSession.createDataFrame([], schema).schema
    none = len(fields) - 2
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)

        def batch(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

        held, size = [], 0
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                out, f = [], None
                try:
                    if content is None:
                        raise ValueError("no content")
                    f = File(content, password)
                    for r in rows(doc_id, f):
                        if len(out) == ROWS_AT_ONCE:  # the first row waits, as problems may still be found
                            yield batch(out[1:])
                            del out[1:]
                        out.append(r)
                    if f.problems and out:
                        out[0] = (*out[0][:-1], "; ".join(f.problems))
                except Exception as e:  # a broken file is a row, not a failed job
                    why = f"{type(e).__name__}: {e}"
                    out = [(*out[0][:-1], why), *out[1:]] if out else [(doc_id, *[None] * none, why)]
                held += out
                size += len(content or b"")
                if len(held) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                    yield batch(held)
                    held, size = [], 0
            release()
        if held:
            yield batch(held)

    return docs.select("doc_id", "content").mapInArrow(run, fields)


def _resolved(f: File, v: Any, depth: int = 8) -> Any:
    """A value as JSON without references; a stream is its decoded data as a string, with its entries."""
    v = f.fetch(v)
    if isinstance(v, Stream):
        return {"$hex": f.decode(v).data.hex(), "entries": {k: _resolved(f, x, depth - 1) for k, x in v.entries.items() if k in ("N", "Range")}}
    if isinstance(v, list) and depth:
        return [_resolved(f, x, depth - 1) for x in v]
    if isinstance(v, dict) and depth:
        return {k: _resolved(f, x, depth - 1) for k, x in v.items()}
    return to_json(v)


def _dump(v: Any) -> str:
    return json.dumps(to_json(v), ensure_ascii=True)


def objects(docs: DataFrame, password: bytes = b"") -> DataFrame:
    """All objects: key, kind, value as VARIANT, and of streams filters, their parameters, place and raw (decrypted, not decoded) data.

    Of images, space_json is the colour space with its references resolved and its streams decoded.
    """

    def rows(doc_id: str, f: File):
        for ref in f.refs():
            v = f.object(ref)
            names, params, start, raw, space = None, None, None, None, None
            if isinstance(v, Stream):
                names, p = filters_of(v.entries, f.fetch)
                params, start, raw = _dump(p), v.start, v.raw
                if v.entries.get("Subtype") == "Image":
                    space = json.dumps(_resolved(f, v.entries.get("ColorSpace")))
            edges = [{"path": path, "num": r.num, "gen": r.gen} for path, r in references(v)]
            yield doc_id, ref.num, ref.gen, kind_of(v), _dump(v), names, params, start, raw, space, edges, None

    out = _scan(docs, OBJECTS, rows, password)
    return out.withColumn("value", F.parse_json("value_json")).drop("value_json")


def edges(objs: DataFrame) -> DataFrame:
    """A row per reference: doc_id, src_num, src_gen, path, dst_num, dst_gen."""
    e = objs.select("doc_id", F.col("obj_num").alias("src_num"), F.col("gen").alias("src_gen"), F.explode("edges").alias("e"))
    return e.select("doc_id", "src_num", "src_gen", F.col("e.path").alias("path"), F.col("e.num").alias("dst_num"), F.col("e.gen").alias("dst_gen"))


def edges_of(docs: DataFrame, password: bytes = b"") -> DataFrame:
    """edges() of all objects, without the rest of them."""

    def rows(doc_id: str, f: File):
        for ref in f.refs():
            for path, r in references(f.object(ref)):
                yield doc_id, ref.num, ref.gen, path, r.num, r.gen, None

    return _scan(docs, EDGES, rows, password).where("src_num is not null").drop("corrupt_reason")


def xref(docs: DataFrame, password: bytes = b"") -> DataFrame:
    """All cross-reference entries of all sections, the newest section is 0."""
    return _scan(docs, XREF, lambda d, f: ((d, e.num, e.type, e.offset, e.gen, e.section, None) for e in f.sections), password)


def _contents(f: File, p: Page) -> list[tuple[Ref, Any]]:
    """A page's contents in order, each with its value if that is known already."""
    c = p.entries.get("Contents")
    held = f.fetch(c) if isinstance(c, Ref) else c
    return [(x, None) for x in held if isinstance(x, Ref)] if isinstance(held, list) else [(c, held)] if isinstance(c, Ref) else []


def pages(docs: DataFrame, password: bytes = b"") -> DataFrame:
    def rows(doc_id: str, f: File):
        for p in f.pages():
            refs = [r for r, _ in _contents(f, p)]
            box = lambda k: [float(f.fetch(x)) for x in p.inherited[k]] if p.inherited.get(k) else None  # noqa: B023, E731
            yield doc_id, p.number, p.ref.num, p.ref.gen, box("MediaBox"), box("CropBox"), int(p.inherited.get("Rotate") or 0), _dump(p.inherited.get("Resources")), [{"num": r.num, "gen": r.gen} for r in refs], _dump(p.entries), None

    out = _scan(docs, PAGES, rows, password)
    return out.withColumn("resources", F.parse_json("resources_json")).withColumn("entries", F.parse_json("entries_json")).drop("resources_json", "entries_json")


def contents(docs: DataFrame, password: bytes = b"") -> DataFrame:
    """A row per content stream of each page, decoded, with its place among the page's contents. One pass over each file and no join."""

    def rows(doc_id: str, f: File):
        for p in f.pages():
            for i, (r, v) in enumerate(_contents(f, p)):
                v = f.fetch(r) if v is None else v
                if isinstance(v, Stream):
                    d = f.decode(v)
                    yield doc_id, p.number, i, r.num, r.gen, d.data, d.left, d.reason, f.handler is not None, None

    return _scan(docs, CONTENTS, rows, password)


def info(docs: DataFrame, password: bytes = b"") -> DataFrame:
    """A row per file: version, counts, and the trailer, catalog and information dictionaries."""

    def rows(doc_id: str, f: File):
        yield doc_id, f.version, len(f.pages()), len(f.refs()), f.handler is not None, _dump(f.trailer), _dump(f.root), _dump(f.fetch(f.trailer.get("Info"))), None

    out = _scan(docs, INFO, rows, password)
    for c in ("trailer", "root", "info"):
        out = out.withColumn(c, F.parse_json(f"{c}_json")).drop(f"{c}_json")
    return out


def selected(docs: DataFrame, start: int, length: int, password: bytes = b"") -> DataFrame:
    """doc_id, content: each file's pages start .. start + length - 1; files with fewer pages have a null content and a reason."""
    return _mapped(docs, lambda c: select_pages(c, start, length, password))


def _mapped(docs: DataFrame, f: Callable[[bytes], bytes]) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out, why = [], []
            for c in b.column("content").to_pylist():
                try:
                    out.append(f(c))
                    why.append(None)
                except Exception as e:
                    out.append(None)
                    why.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()), pa.array(why, pa.string())], ["doc_id", "content", "corrupt_reason"])

    return docs.select("doc_id", "content").mapInArrow(run, "doc_id string, content binary, corrupt_reason string")


def merged(docs: DataFrame, group: str, order: list[str], password: bytes = b"") -> DataFrame:
    """One file per group of all its files' pages in order. A group's files meet in one task, as they become one file."""

    def run(key, table):
        t = table.sort_by([(c, "ascending") for c in order])
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.string()), "content": pa.array([merge(t["content"].to_pylist(), password)], pa.binary())})

    return docs.withColumn(group, F.col(group).cast("string")).groupBy(group).applyInArrow(run, "doc_id string, content binary")


def contained(objs: DataFrame, entries: DataFrame) -> DataFrame:
    """Objects inside object streams by a join: doc_id, obj_num, container, place, source (the object's text).

    objs: objects(); entries: xref(). Each object stream is decoded and its header split into a row per
    object; entries of type c name the stream and the place in it.
    """
    kind = F.try_variant_get("value", "$.Type['$name']", "string")
    num = lambda c: F.try_variant_get("value", c, "int")
    streams = objs.where((F.col("kind") == "stream") & (kind == "ObjStm")).withColumn("d", decode_stream(F.col("raw"), F.col("filters"), F.col("params_json"))["data"])
    held = streams.select("doc_id", F.col("obj_num").alias("container"), num("$.N").alias("n"), num("$.First").alias("first"), "d")
    # the header is ASCII: number and start of each object; the body begins at `first`
    head = F.split(F.trim(F.regexp_replace(F.decode(F.substring("d", F.lit(1), F.col("first")), "ISO-8859-1"), r"\s+", " ")), " ")
    starts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at(head, i * 2 + 2).cast("int"))
    held = held.where("n > 0").withColumn("starts", starts).withColumn("end", F.length("d") - F.col("first"))
    # the pieces are cut before they become rows, so that no row carries the whole stream
    stop = lambda i: F.coalesce(F.get("starts", i + 1), F.col("end"))
    pieces = F.transform("starts", lambda x, i: F.substring("d", F.col("first") + x + 1, stop(i) - x))
    each = held.select("doc_id", "container", F.posexplode(pieces).alias("place", "source"))
    listed = entries.where("type = 'c'").select("doc_id", "obj_num", F.col("off").cast("int").alias("container"), F.col("gen").alias("place"))
    return listed.join(each, ["doc_id", "container", "place"])


def _documents(made: list[tuple[str, bytes]]) -> pa.RecordBatch:
    ids, data = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(data, pa.binary())], ["doc_id", "content"])


def built(rows: DataFrame, user: bytes | None = None, owner: bytes = b"", revision: int = 3, aes: bool = False, compact: bool = False) -> DataFrame:
    """doc_id, content: a file made of each row, and nothing else of it is kept.

    rows: doc_id (string); texts (array of string): a page each, its content; optionally title, filters
    (array of string) and params_json, the chain that contents are encoded by, boxes (array of array of
    double) and turns (array of int). Null texts give a file without pages. Encrypted if a user password
    is given; compact puts objects into an object stream instead. Object 1 is the page tree, 2 the information; page i (from 1) is object 2 i + 2 and its
    content the one before; then comes the catalog.
    """
    given = [c for c in ("title", "filters", "params_json", "boxes", "turns") if c in rows.columns]
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cols, made, held = {c: b.column(c).to_pylist() for c in ["doc_id", "texts", *given]}, [], 0
            for i in range(b.num_rows):
                r = {k: v[i] for k, v in cols.items()}
                w = Writer()
                w.info = w.add({"Title": (r.get("title") or "").encode()})
                params = json.loads(r["params_json"]) if r.get("params_json") else None
                for k, text in enumerate(r["texts"] or []):
                    body = w.add(stream((text or "").encode(), r.get("filters"), params))
                    w.page((r.get("boxes") or {k: [0, 0, 612, 792]})[k], [body], rotate=r["turns"][k] if r.get("turns") else 0)
                made.append((r["doc_id"], w.compact_bytes() if compact else w.bytes(user, owner, revision, aes)))
                held += len(made[-1][1])
                if held >= BYTES_AT_ONCE or len(made) >= ROWS_AT_ONCE:
                    yield _documents(made)
                    made, held = [], 0
            if made:
                yield _documents(made)
            release()

    return dealt(rows.select("doc_id", "texts", *given)).mapInArrow(run, "doc_id string, content binary")


def built_images(rows: DataFrame) -> DataFrame:
    """doc_id, content: a file of one page and one image per row.

    rows: doc_id (string), data (binary, samples), width, height, bits, space (a name, `ICCBased` with
    icc components, or `Indexed` over DeviceRGB with a palette), icc (int), palette (binary), filters
    (array of string). Object 2 is the image, or follows its profile or palette.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            made, held = [], 0
            for r in b.to_pylist():
                w = Writer()
                space: Any = Name(r["space"])
                if r["space"] == "ICCBased":
                    space = [space, w.add(stream(b"profile", ["FlateDecode"], N=r["icc"]))]
                elif r["space"] == "Indexed":
                    space = [space, Name("DeviceRGB"), len(r["palette"]) // 3 - 1, w.add(stream(r["palette"], ["FlateDecode"]))]
                image = w.add(stream(r["data"], r["filters"], Type=Name("XObject"), Subtype=Name("Image"), Width=r["width"], Height=r["height"], BitsPerComponent=r["bits"], ColorSpace=space))
                w.page([0, 0, 612, 792], [], {"XObject": {"Im1": image}})
                made.append((r["doc_id"], w.bytes()))
                held += len(made[-1][1])
                if held >= BYTES_AT_ONCE or len(made) >= ROWS_AT_ONCE:
                    yield _documents(made)
                    made, held = [], 0
            if made:
                yield _documents(made)
            release()

    small_batches(rows.sparkSession)
    return dealt(rows.select("doc_id", "data", "width", "height", "bits", "space", "icc", "palette", "filters")).mapInArrow(run, "doc_id string, content binary")
