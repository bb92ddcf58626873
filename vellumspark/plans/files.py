"""Queries over files: made from the rows of a table, then read, followed, cut, joined, sealed and written like any others.

A file per document: its lines are the pages. SQL knows what must come back from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark import functions as fn
from vellumspark.documents import frames
from vellumspark.engine import Engine
from vellumspark.operators import graph
from vellumspark.operators.base import shared_path, stored
from vellumspark.plans.registry import query
from vellumspark.sinks.files import write_files
from vellumspark.sources import bitmaps, data_source

#: Chains that contents are encoded by, one for each remainder of doc_id.
CHAINS = (["FlateDecode"], ["ASCII85Decode", "LZWDecode"], ["ASCIIHexDecode", "RunLengthDecode"], [], ["LZWDecode"], ["FlateDecode"])
PNG_ROWS = '[{"Predictor": 15, "Columns": 16}]'
LINES_SQL = """l as (select lpad(cast(doc_id as varchar), 12, '0') as doc, doc_id, string_split(text, chr(10)) as l from documents),
n as (select *, len(l) as n from l), pg as (select *, unnest(range(1, n + 1)) as i from n)"""


def _name(c: str = "doc_id") -> Column:
    return F.lpad(F.col(c).cast("string"), 12, "0")


def _built(t, **sealed) -> DataFrame:
    lines = F.split("text", "\n")
    chain = F.array(*[F.array(*[F.lit(f) for f in c]).cast("array<string>") for c in CHAINS])
    k = (F.col("doc_id") % len(CHAINS)).cast("int")
    boxes = F.transform(lines, lambda x: F.array(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.length(x) + F.lit(0.5)))
    d = t("documents").select(
        _name().alias("doc_id"), lines.alias("texts"), F.concat(F.lit("title (of) "), "source").alias("title"), F.get(chain, k).alias("filters"),
        F.when(k == 5, PNG_ROWS).alias("params_json"), boxes.alias("boxes"), F.transform(lines, lambda x, i: (i % 4) * 90).alias("turns"),
    )
    return frames.built(d, **sealed)


def _engine(t, **sealed) -> Engine:
    docs = _built(t, **sealed)
    return Engine(docs.sparkSession, docs=docs)


def _texts(e: Engine, *more: str) -> DataFrame:
    """doc_id, page_no, text of each page's one content, and more of its columns."""
    return e.contents().where("page_no is not null and place = 0").select("doc_id", "page_no", F.col("data").cast("string").alias("text"), *more)


@query(f"""with {LINES_SQL} select doc as doc_id, cast(i as int) as page_no, cast(2 * i + 2 as int) as num, 0 as gen, cast((i - 1) % 4 * 90 as int) as rotate, cast(length(l[i]) + 0.5 as float) as height, cast(2 * i + 1 as int) as content from pg""")
def file_pages(t):
    p = _engine(t).pages()
    return p.select("doc_id", "page_no", "num", "gen", "rotate", F.get("mediabox", 3).alias("height"), F.get("contents", 0)["num"].alias("content"))


@query(f"""with {LINES_SQL} select doc as doc_id, '1.4' as version, cast(n as int) as pages, cast(2 * n + 3 as int) as objects, false as encrypted, cast(2 * n + 4 as int) as size, cast(2 * n + 3 as int) as root,
'title (of) ' || (select source from documents d where d.doc_id = n.doc_id) as title, 'Catalog' as type, true as fine from n""")
def file_info(t):
    """Trailer, catalog and information; the counts that the file states agree with what it holds."""
    i = _engine(t).info()
    title = F.decode(F.unhex(F.try_variant_get("info", "$.Title['$hex']", "string")), "UTF-8")
    size, root = fn.get_required(F.col("trailer"), "$.Size", "int"), fn.get_reference(F.col("trailer"), "$.Root")["num"]
    return i.select("doc_id", "version", "pages", "objects", "encrypted", size.alias("size"), root.alias("root"), title.alias("title"), fn.get_name(F.col("root"), "$.Type").alias("type"), F.col("corrupt_reason").isNull().alias("fine"))


@query(f"""with {LINES_SQL} select doc as doc_id, 1 as obj_num, 'dict' as kind, 'Pages' as type from n union all select doc, 2, 'dict', null from n union all select doc, cast(2 * n + 3 as int), 'dict', 'Catalog' from n
union all select doc, cast(2 * i + 1 as int), 'stream', null from pg union all select doc, cast(2 * i + 2 as int), 'dict', 'Page' from pg""")
def file_objects(t):
    return _engine(t).objects().select("doc_id", "obj_num", "kind", fn.get_name(F.col("value"), "$.Type").alias("type"))


@query(f"""with {LINES_SQL} select doc as doc_id, cast(2 * n + 3 as int) as src_num, '$.Pages' as path, 1 as dst_num from n union all select doc, 1, '$.Kids[' || (i - 1) || ']', cast(2 * i + 2 as int) from pg
union all select doc, cast(2 * i + 2 as int), '$.Parent', 1 from pg union all select doc, cast(2 * i + 2 as int), '$.Contents', cast(2 * i + 1 as int) from pg""")
def file_edges(t):
    return _engine(t).edges().select("doc_id", "src_num", "path", "dst_num")


@query(f"""with {LINES_SQL}, o as (select doc, unnest(range(0, 2 * n + 4)) as k from n) select doc as doc_id, cast(k as int) as obj_num, case when k = 0 then 'f' else 'n' end as type, case when k = 0 then 65535 else 0 end as gen, 0 as section, true as found from o""")
def file_xref(t):
    """Cross-reference entries; where one points to, its object begins."""
    docs = stored(_built(t), "files")
    x = frames.xref(docs).join(docs, "doc_id")
    head = F.concat(F.col("obj_num").cast("string"), F.lit(" 0 obj")).cast("binary")
    return x.select("doc_id", "obj_num", "type", "gen", "section", ((F.col("type") == "f") | (F.substring("content", F.col("off").cast("int") + 1, F.length(head)) == head)).alias("found"))


@query(f"""with {LINES_SQL}, o as (select doc, n, unnest(range(1, 2 * n + 4)) as k from n) select doc as doc_id, cast(k as int) as obj_num, k = 2 * n + 3 as last, true as found from o""")
def file_ends(t):
    """The offset where each object ends: the next one's begin, behind the end of this one."""
    docs = stored(_built(t), "files")
    e = Engine(docs.sparkSession, docs=docs).ends().join(docs, "doc_id")
    tail = F.substring("content", F.col("end_off").cast("int") - 6, F.lit(7)) == F.lit(b"endobj\n")
    return e.select("doc_id", "obj_num", F.col("end_off").isNull().alias("last"), F.coalesce(tail, F.lit(True)).alias("found"))


@query(f"""with {LINES_SQL}, o as (select doc, n, unnest([0, 1, 2, 2 * n + 3, 2 * n + 4, 2 * n + 5] || range(3, 2 * n + 3)) as k from n)
select doc as doc_id, cast(k as int) as obj_num, case when k = 0 then 'f' when k > 2 * n + 3 or (k % 2 = 1 and k between 3 and 2 * n + 2) then 'n' else 'c' end as type, 0 as section from o""")
def file_xref_streams(t):
    """Cross-reference streams: objects in use, and those inside an object stream."""
    return frames.xref(_built(t, compact=True)).select("doc_id", "obj_num", "type", "section")


@query(f"""with {LINES_SQL} select doc as doc_id, cast(2 * i + 2 as int) as obj_num, cast(2 * n + 4 as int) as container, cast(i + 1 as int) as place, true as page from pg
union all select doc, unnest([1, 2, cast(2 * n + 3 as int)]), cast(2 * n + 4 as int), unnest([0, 1, cast(n + 2 as int)]), false from n""")
def file_contained(t):
    """Objects inside object streams, found by joining the entries with the streams' contents."""
    docs = stored(_built(t, compact=True), "files")
    c = Engine(docs.sparkSession, docs=docs).contained()
    text = F.decode("source", "ISO-8859-1")
    return c.select("doc_id", "obj_num", "container", "place", (text.startswith("<<") & F.contains(text, F.lit("/Type /Page\n"))).alias("page"))


@query(f"""with {LINES_SQL} select doc as doc_id, cast(i as int) as page_no, l[i] as text from pg""")
def file_compact_text(t):
    """Contents of all pages of files with object streams."""
    return _texts(_engine(t, compact=True))


@query("""with b as (select user_id, list(case when event_type = 'click' then 1 else 0 end order by event_id) as bits from events group by user_id),
p as (select user_id, len(bits) as width, lower(array_to_string(list_transform(regexp_extract_all(rpad(array_to_string(bits, ''), cast(ceil(len(bits) / 8.0) * 8 as int), '0'), '.{8}'), lambda x: printf('%02x', cast(list_reduce(list_transform(string_split(x, ''), lambda c: cast(c as int)), lambda p, q: p * 2 + q) as int))), '')) as h from b)
select k || user_id as doc_id, cast(width as int) as width, 2 as height, cast(row as int) as row, h as bits from p, (values ('P1-'), ('P4-')) v(k), (values (0), (1)) r(row)""")
def bitmap_files(t):
    """Bitmap files, plain and packed, of two equal rows per user, as scanlines."""
    e = t("events").select("user_id", F.struct("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("b")).alias("e"))
    b = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["b"]).alias("bits"))
    line, packed = F.array_join("bits", ""), fn.pack_bits(F.col("bits"), 1)
    head = lambda k: F.concat(F.lit(f"{k}\n# two rows\n"), F.size("bits").cast("string"), F.lit(" 2\n"))
    plain = F.concat(head("P1"), line, F.lit("\n"), line, F.lit("\n")).cast("binary")
    raw = F.concat(head("P4").cast("binary"), packed, packed)
    files = b.select(F.concat(F.lit("P1-"), "user_id").alias("doc_id"), plain.alias("content")).union(b.select(F.concat(F.lit("P4-"), "user_id"), raw))
    return bitmaps.scanlines(files).select("doc_id", "width", "height", "row", fn.to_hex(F.col("bits")).alias("bits"))


@query(f"""with {LINES_SQL} select doc as doc_id, cast(i as int) as page_no, l[i] as text from pg""")
def file_text(t):
    """Contents of all pages, through six chains of filters."""
    return _texts(_engine(t))


@query(f"""with {LINES_SQL} select doc as doc_id, cast(n as int) as count, cast(n as int) as kids from n""")
def file_object(t):
    """One object of each file, the page tree, and what its dictionary holds."""
    o = _engine(t).object(1)
    return o.select("doc_id", fn.get_required(F.col("value"), "$.Count", "int").alias("count"), F.size(F.variant_get("value", "$.Kids", "array<variant>")).alias("kids"))


@query(f"""with {LINES_SQL} select doc as doc_id, cast(6 as int) as num, cast(case when n >= 2 then 90 end as int) as rotate from n where n >= 2""")
def file_page(t):
    return _engine(t).page(2).select("doc_id", "num", "rotate")


@query(f"""with {LINES_SQL} select doc as doc_id, cast(2 * i + 1 as int) as obj_num from pg where regexp_full_match(left(hex(encode(l[i])), 512), '(09|0A|0B|0C|0D|[2-6][0-9A-F]|7[0-9A-E])*')""")
def file_printable(t):
    """Streams whose first 256 decoded bytes are text."""
    return _engine(t).printable().select("doc_id", "obj_num")


@query(f"""with {LINES_SQL}, s as (select doc, cast(2 * i + 1 as int) as obj_num, l[i] as x, regexp_full_match(left(hex(encode(l[i])), 512), '(09|0A|0B|0C|0D|[2-6][0-9A-F]|7[0-9A-E])*') as ok from pg)
select doc as doc_id, obj_num, sha256(x) as raw, case when ok then sha256(x) end as shown from s""")
def file_outputs(t):
    """Streams at two stages of output: decoded, and decoded if they are text."""
    e = _engine(t)
    o = e.outputs(["raw", "default"]).where("kind = 'stream'")
    return o.select("doc_id", "obj_num", F.sha2("raw", 256).alias("raw"), F.sha2("default", 256).alias("shown"))


@query(f"""with {LINES_SQL}, h as (select doc, lower(hex(encode(l[1]))) as h from n),
s as (select doc, h, unnest(range((length(h) // 2 + 15) // 16)) as i from h where length(h) > 0)
select doc as doc_id, cast(i as int) as line_no, printf('%08x', i * 16) || '  ' || regexp_replace(rpad(regexp_replace(substr(h, i * 32 + 1, 32), '(..)', '\\1 ', 'g'), 48, ' '), '^(.{{24}})', '\\1 ') || ' ' ||
array_to_string(list_transform(regexp_extract_all(substr(h, i * 32 + 1, 32), '..'), lambda b: case when b between '20' and '7e' then chr(cast('0x' || b as int)) else '.' end), '') as line from s""")
def file_hexdump(t):
    """The first page's content of each file as a dump."""
    return _engine(t).hexdump(3)


@query(f"""with {LINES_SQL} select doc as doc_id, cast(2 * n + 3 as int) as root, unnest([1, 2 * n + 3] || range(3, 2 * n + 3)) as obj_num from n""")
def file_reachable(t):
    """All objects that references reach from each file's catalog: all but the information."""
    docs = stored(_built(t), "files")
    e = Engine(docs.sparkSession, docs=docs)
    starts = e.info().select("doc_id", fn.get_reference(F.col("trailer"), "$.Root").alias("r")).select("doc_id", "r.num", "r.gen")
    part = lambda c, i: F.get(F.split(c, " "), i)
    r = e.reachable(starts)
    return r.select(part("root", 0).alias("doc_id"), part("root", 1).cast("int").alias("root"), part("node", 1).cast("long").alias("obj_num"))


@query(f"""with {LINES_SQL} select doc as doc_id, cast(2 * n + 3 as int) as n_objects, cast(3 * n + 1 as bigint) as n_edges, cast(n as int) as page_count, true as agrees from n""")
def file_page_tree(t):
    """Leaves of the page tree against its stated count, by a join of children to the parent that they name."""
    value = F.col("value")
    kind, count = fn.get_name(value, "$.Type"), F.when(fn.get_name(value, "$.Type") == "Pages", fn.get_required(value, "$.Count", "int"))
    o = stored(_engine(t).objects().select("doc_id", "obj_num", "gen", "edges", kind.alias("type"), count.alias("stated")), "objects")
    edges = frames.edges(o)
    parents = edges.where("path = '$.Parent'").select("doc_id", F.concat_ws(" ", "doc_id", "dst_num").alias("parent"))
    tree = o.where("type = 'Pages'").select("doc_id", F.concat_ws(" ", "doc_id", "obj_num").alias("key"), "stated")
    checked = graph.count_mismatches(parents, "parent", tree, "key", "stated")
    sums = o.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_objects"), F.sum(F.size("edges")).alias("n_edges"))
    both = checked.select(F.substring_index("key", " ", 1).alias("doc_id"), F.col("stated").alias("page_count"), F.col("matches").alias("agrees"))
    return sums.join(both, "doc_id")


@query(f"""with {LINES_SQL} select doc as doc_id, cast(i - 1 as int) as page_no, l[i] as text from pg where n >= 3 and i between 2 and 3 union all select doc, null, 'IndexError' from n where n < 3""")
def file_select(t):
    """Files of pages 2 and 3; a file that lacks one has a reason instead."""
    made = stored(_engine(t).select_pages(2, 2), "selected")
    texts = _texts(Engine(made.sparkSession, docs=made.where("content is not null")))
    return texts.union(made.where("content is null").select("doc_id", F.lit(None).cast("int"), F.substring_index("corrupt_reason", ":", 1)))


@query(f"""with {LINES_SQL} select cast(doc_id // 16 as varchar) as doc_id, cast(row_number() over (partition by doc_id // 16 order by doc, i) as int) as page_no, l[i] as text from pg""")
def file_merge(t):
    """Sixteen files in a row joined to one, again and again."""
    docs = _built(t).withColumn("group", F.floor(F.col("doc_id").cast("long") / 16))
    made = stored(Engine(docs.sparkSession, docs=docs).merge("group"), "merged")
    return _texts(Engine(made.sparkSession, docs=made))


@query(f"""with {LINES_SQL} select doc as doc_id, true as same, cast(n as int) as pages from n""")
def file_written(t):
    """Files written to a folder, found there and read again."""
    docs = stored(_built(t), "files")
    spark, folder = docs.sparkSession, shared_path(docs.sparkSession, "written")
    written = stored(write_files(docs, folder), "listed")
    found = stored(frames.files(spark, folder).withColumn("doc_id", fn.extension(fn.base_name(F.col("doc_id")))["stem"]), "found")
    same = found.join(docs.select("doc_id", F.col("content").alias("was")), "doc_id").join(written, "doc_id").select("doc_id", ((F.col("content") == F.col("was")) & (F.length("content") == F.col("bytes"))).alias("same"))
    return same.join(frames.info(found).select("doc_id", "pages"), "doc_id")


@query(f"""with {LINES_SQL} select doc as doc_id, 1 as obj_num, 'dict' as kind from n union all select doc, 3, 'stream' from n""")
def file_source(t):
    """Files in a folder through the data source, of which only two objects are parsed."""
    docs = _built(t)
    spark, folder = docs.sparkSession, shared_path(docs.sparkSession, "source")
    write_files(docs, folder).write.format("noop").mode("overwrite").save()
    data_source.register(spark)
    rows = spark.read.format("page_objects").load(folder).where("obj_num in (1, 3)")
    return rows.select(fn.extension(fn.base_name(F.col("doc_id")))["stem"].alias("doc_id"), "obj_num", "kind")


@query(f"""with {LINES_SQL} select doc as doc_id, true as broken, true as headless from n""")
def file_broken(t):
    """Files cut in half, and files without their first bytes: a row with a reason each."""
    docs = _built(t)
    half = frames.info(docs.select("doc_id", F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int")).alias("content")))
    none = frames.info(docs.select("doc_id", F.expr("substring(content, 20)").alias("content")))
    bad = lambda c: (F.col("version").isNull() & F.col("corrupt_reason").startswith("FileError")).alias(c)
    return half.select("doc_id", bad("broken")).join(none.select("doc_id", bad("headless")), "doc_id")


SEALS = ((2, False), (3, False), (4, False), (4, True), (5, True))


@query("""with c as (select lpad(cast(c_custkey as varchar), 12, '0') as doc, unnest([1, 2]) as i, c_name, c_mktsegment from customer), w as (select unnest(['user', 'owner']) as opened)
select doc as doc_id, i as page_no, case i when 1 then c_name else c_mktsegment end as text, true as encrypted, opened, true as refused from c, w""")
def file_sealed(t):
    """A file per customer, sealed under each revision of the security handler; opened by either password, refused to another."""
    c = t("customer").select(_name("c_custkey").alias("doc_id"), F.array("c_name", "c_mktsegment").alias("texts"), F.col("c_custkey") % len(SEALS))
    names = ["doc_id", "texts", "k"]
    docs = [frames.built(c.toDF(*names).where(F.col("k") == i), b"user", b"owner", r, aes) for i, (r, aes) in enumerate(SEALS)]
    sealed = docs[0]
    for d in docs[1:]:
        sealed = sealed.unionByName(d)
    sealed = stored(sealed, "sealed")
    spark, out = sealed.sparkSession, None
    refused = frames.info(sealed, b"wrong").select("doc_id", F.col("corrupt_reason").startswith("SecurityError").alias("refused"))
    for who in ("user", "owner"):
        one = _texts(Engine(spark, docs=sealed, password=who.encode()), "encrypted").withColumn("opened", F.lit(who))
        out = one if out is None else out.unionByName(one)
    return out.join(refused, "doc_id")


@query("""with d as (select lpad(cast(doc_id as varchar), 12, '0') as doc, doc_id % 5 as k, encode(text) as b, octet_length(encode(text)) as n, hex(encode(text)) as h from documents where octet_length(encode(text)) > 0)
select doc as doc_id, case k when 1 then 'ppm' when 2 then 'ppm' when 4 then 'pbm' else 'pgm' end as format, case k when 0 then sha256(encode(printf('P5\n%d 1\n255\n', n)) || b) when 1 then sha256(encode(printf('P6\n%d 1\n255\n', n)) || b || b || b)
when 2 then sha256(encode(printf('P6\n%d 1\n255\n', n)) || unhex(regexp_replace(h, '(..)', '\\1\\1\\1', 'g'))) when 3 then sha256(encode(printf('P5\n%d 1\n255\n', n)) || b)
else sha256(encode(printf('P4\n8 %d\n', n)) || unhex(translate(h, '0123456789ABCDEF', 'FEDCBA9876543210'))) end as file from d""".replace("\\\\1", "\\1"))
def file_images(t):
    """Texts as samples: gray, three components of a profile, through a palette, a profile's one component, and single bits."""
    k, b = F.col("doc_id") % 5, F.col("text").cast("binary")
    n = F.length(b)
    palette = F.lit(b"".join(bytes([i, i, i]) for i in range(256)))
    space = F.when(k == 2, "Indexed").when(k.isin(1, 3), "ICCBased").otherwise("DeviceGray")
    d = t("documents").where(n > 0).select(
        _name().alias("doc_id"), F.when(k == 1, F.concat(b, b, b)).otherwise(b).alias("data"), F.when(k == 4, 8).otherwise(n).alias("width"), F.when(k == 4, n).otherwise(1).alias("height"),
        F.when(k == 4, 1).otherwise(8).alias("bits"), space.alias("space"), F.when(k == 1, 3).otherwise(1).alias("icc"), palette.alias("palette"),
        F.when(k == 3, F.array(F.lit("LZWDecode"))).otherwise(F.array(F.lit("FlateDecode"))).alias("filters"),
    )
    docs = frames.built_images(d)
    return Engine(docs.sparkSession, docs=docs).images().select("doc_id", "format", F.sha2("data", 256).alias("file"))


@query("""select lpad(cast(c_custkey as varchar), 12, '0') as doc_id, 1 as page_no, sha256(encode(printf('P5\n8 %d\n255\n', octet_length(encode(c_name)))) || unhex(array_to_string(list_transform(regexp_extract_all(hex(encode(c_name)), '.'), lambda d: replace(replace(lpad(bin(cast('0x' || d as int)), 4, '0'), '0', '00'), '1', 'FF')), ''))) as shown from customer""")
def file_thumbnails(t):
    """One-bit images that are small enough to be shown as they are: a gray value for each bit."""
    b, none = F.col("c_name").cast("binary"), F.lit(None)
    d = t("customer").select(
        _name("c_custkey").alias("doc_id"), b.alias("data"), F.lit(8).alias("width"), F.length(b).alias("height"), F.lit(1).alias("bits"), F.lit("DeviceGray").alias("space"),
        none.cast("int").alias("icc"), none.cast("binary").alias("palette"), F.array(F.lit("RunLengthDecode")).alias("filters"),
    )
    docs = frames.built_images(d)
    return Engine(docs.sparkSession, docs=docs).thumbnails().select("doc_id", "page_no", F.sha2("data", 256).alias("shown"))
