"""Queries that encode whole tables with each stream codec and decode them again; SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark import functions as fn
from vellumspark.codecs import columns
from vellumspark.plans.registry import query

BACK_SQL = "select doc_id, sha256(text) as back, 0 as unread from documents"


def _round_trip(t, filters: list[str], params: list | None = None):
    d = t("documents").select("doc_id", columns.encode_stream(F.col("text").cast("binary"), filters, params).alias("e"))
    d = d.select("doc_id", columns.decode_stream(F.col("e"), filters, params).alias("d"))
    return d.select("doc_id", F.sha2("d.data", 256).alias("back"), F.size("d.left").alias("unread"))


@query("""select doc_id, regexp_replace(lower(hex(encode(text))), '(.{70})', '\\1' || chr(10), 'g') || '>' as written from documents where octet_length(encode(text)) % 35 > 0
union all select doc_id, regexp_replace(regexp_replace(lower(hex(encode(text))), '(.{70})', '\\1' || chr(10), 'g'), '.$', '', 's') || '>' from documents where octet_length(encode(text)) % 35 = 0""")
def codec_hex_written(t):
    return t("documents").select("doc_id", F.decode(columns.encode_stream(F.col("text").cast("binary"), ["ASCIIHexDecode"]), "US-ASCII").alias("written"))


@query(BACK_SQL)
def codec_hex(t):
    return _round_trip(t, ["ASCIIHexDecode"])


@query(BACK_SQL)
def codec_base85(t):
    return _round_trip(t, ["ASCII85Decode"])


@query("""select doc_id, cast(5 * (octet_length(encode(text)) // 4) + case when octet_length(encode(text)) % 4 > 0 then octet_length(encode(text)) % 4 + 1 else 0 end as bigint) as characters from documents""")
def codec_base85_size(t):
    """Texts hold no four zero bytes, so each four bytes are five characters."""
    e = F.decode(columns.encode_stream(F.col("text").cast("binary"), ["ASCII85Decode"]), "US-ASCII")
    return t("documents").select("doc_id", F.length(F.regexp_replace(F.regexp_replace(e, "\\s", ""), "~>$", "")).cast("long").alias("characters"))


@query(BACK_SQL)
def codec_lzw(t):
    return _round_trip(t, ["LZWDecode"])


@query(BACK_SQL)
def codec_lzw_late(t):
    """Code widths that grow one code later."""
    return _round_trip(t, ["LZWDecode"], [{"EarlyChange": 0}])


@query(BACK_SQL)
def codec_flate(t):
    return _round_trip(t, ["FlateDecode"])


@query(BACK_SQL)
def codec_runlength(t):
    return _round_trip(t, ["RunLengthDecode"])


@query(BACK_SQL)
def codec_predictor_png(t):
    """Rows of 24 bytes, the best filter for each."""
    return _round_trip(t, ["FlateDecode"], [{"Predictor": 15, "Colors": 3, "Columns": 8}])


@query(BACK_SQL)
def codec_predictor_tiff(t):
    """Rows of eight pixels of three colours, as differences to the pixel before."""
    return _round_trip(t, ["LZWDecode"], [{"Predictor": 2, "Colors": 3, "Columns": 8}])


@query(BACK_SQL)
def codec_chain(t):
    """Three filters one after another, the first of them a crypt filter that changes nothing."""
    filters = ["ASCII85Decode", "RunLengthDecode", "FlateDecode"]
    d = t("documents").select("doc_id", columns.encode_stream(F.col("text").cast("binary"), filters, [None, None, {"Predictor": 12, "Columns": 16}]).alias("e"))
    d = d.select("doc_id", columns.decode_stream(F.col("e"), ["Crypt", *filters], [None, None, None, {"Predictor": 12, "Columns": 16}]).alias("d"))
    return d.select("doc_id", F.sha2("d.data", 256).alias("back"), F.size("d.left").alias("unread"))


@query("""select doc_id, sha256(text) as back, ['JBIG2Decode', 'JPXDecode', 'DCTDecode', 'Unknown'][doc_id % 4 + 1] as unread from documents""")
def codec_unread(t):
    """Filters that nothing here reads leave the data as it is, and are named."""
    name = F.get(F.array(*[F.lit(x) for x in ("JBIG2Decode", "JPXDecode", "DCTDecode", "Unknown")]), (F.col("doc_id") % 4).cast("int"))
    d = t("documents").select("doc_id", columns.decode_stream(columns.encode_stream(F.col("text").cast("binary"), ["FlateDecode"]), F.array(F.lit("FlateDecode"), name)).alias("d"))
    return d.select("doc_id", F.sha2("d.data", 256).alias("back"), F.get("d.left", 0).alias("unread"))


@query(BACK_SQL)
def codec_sql(t):
    """The codecs by their SQL names."""
    d = t("documents")
    columns.register(d.sparkSession)
    d = d.selectExpr("doc_id", "encode_stream(cast(text as binary), array('LZWDecode'), null) as e").selectExpr("doc_id", "decode_stream(e, array('LZWDecode'), null) as d")
    return d.select("doc_id", F.sha2("d.data", 256).alias("back"), F.size("d.left").alias("unread"))


BITS_SQL = """with b as (select user_id, list(case when event_type = 'click' then 1 else 0 end order by event_id) as bits from events group by user_id),
p as (select user_id, lower(array_to_string(list_transform(regexp_extract_all(rpad(array_to_string(bits, ''), cast(ceil(len(bits) / 8.0) * 8 as int), '0'), '.{8}'), lambda x: printf('%02x', cast(list_reduce(list_transform(string_split(x, ''), lambda c: cast(c as int)), lambda p, q: p * 2 + q) as int))), '')) as h from b)
select user_id, k, h || h || repeat('0', length(h)) || h as rows from p, (values (-1), (0), (4)) v(k)"""


@query(BITS_SQL)
def codec_fax(t):
    """Bitmaps of four rows, one per user, through group 4, group 3 and group 3 with two dimensions."""
    e = t("events").select("user_id", F.struct("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("b")).alias("e"))
    b = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["b"]).alias("bits"))
    row = fn.pack_bits(F.col("bits"), 1)
    image = F.concat(row, row, F.unhex(F.repeat(F.lit("00"), F.length(row))), row)
    b = b.select("user_id", F.size("bits").alias("width"), image.alias("image")).withColumn("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(4))))
    coded = b.withColumn("c", columns._fax_encode("image", "width", "k"))
    return coded.select("user_id", "k", fn.to_hex(columns._fax_decode("c", "width", "k")).alias("rows"))


@query(BITS_SQL.replace("select user_id, k, h || h || repeat('0', length(h)) || h as rows from p, (values (-1), (0), (4)) v(k)", "select user_id, h || h as rows from p"))
def codec_fax_filter(t):
    """The fax codec as a stream filter, where white is 1 and padding too; inverted again it is the bitmap."""
    e = t("events").select("user_id", F.struct("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("b")).alias("e"))
    b = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["b"]).alias("bits"))
    row = fn.pack_bits(F.col("bits"), 1)
    params = F.concat(F.lit('[{"K": -1, "Columns": '), F.size("bits").cast("string"), F.lit(', "BlackIs1": true}]'))
    coded = b.select("user_id", params.alias("p"), columns.encode_stream(F.concat(row, row), ["CCITTFaxDecode"], params).alias("c"))
    return coded.select("user_id", fn.to_hex(columns.decode_stream(F.col("c"), ["CCITTFaxDecode"], F.col("p"))["data"]).alias("rows"))
