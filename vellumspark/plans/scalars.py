"""Queries that run the scalar functions over whole tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark import functions as fn
from vellumspark.codecs import columns
from vellumspark.functions import colour
from vellumspark.operators import graph, rows
from vellumspark.operators.base import shared_path
from vellumspark.plans.registry import query
from vellumspark.sources import lines


@query(r"""select doc_id, cast(len(regexp_extract_all(text, '[\x00\t\n\x0c\r ]')) as bigint) as spaces, cast(len(regexp_extract_all(text, '[\x00\t\n\x0c\r ()<>\[\]{}/%]')) as bigint) as delims from documents""")
def char_classes(t):
    chars = F.split("text", "")
    of = lambda f: F.size(F.filter(chars, f)).cast("long")
    return t("documents").select("doc_id", of(fn.is_space).alias("spaces"), of(fn.is_delim).alias("delims"))


@query("""select doc_id, text as normal, case when doc_id % 3 = 0 then 2 when doc_id % 3 = 1 then 1 else 0 end as first from documents""")
def eol_forms(t):
    """Line ends as CR LF or CR, made LF again, and the length of the one in front."""
    d = t("documents")
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    front = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\r").otherwise("x")
    return d.select("doc_id", fn.normal_eol(F.replace("text", F.lit("\n"), end)).alias("normal"), fn.eol_length(F.concat(front, F.lit("y"))).alias("first"))


@query("""select doc_id, lower(hex(encode(text))) as whole, case when octet_length(encode(text)) > 0 then lower(left(hex(encode(text)), 2 * cast(octet_length(encode(text)) as int) - 1)) || '0' else '' end as odd,
case when contains('0123456789ABCDEF', left(upper(source), 1)) then cast('0x' || left(source, 1) as int) else -1 end as digit from documents""")
def hex_strings(t):
    """Hex text with white space in it, and with its last digit gone."""
    d = t("documents")
    spaced = F.regexp_replace(F.hex("text"), "(.{10})", "$1 \n")
    odd = F.substring(F.hex("text"), F.lit(1), F.greatest(F.length(F.hex("text")) - 1, F.lit(0)))
    return d.select("doc_id", fn.to_hex(fn.parse_hex(spaced)).alias("whole"), fn.to_hex(fn.parse_hex(odd)).alias("odd"), fn.one_hex(F.substring("source", 1, 1)).alias("digit"))


@query(r"""select doc_id, '(' || replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)') || ')' as written, lower(hex(encode(text))) as back from documents""")
def literal_strings(t):
    """Whole texts as literal strings, and read back."""
    d = t("documents").select("doc_id", fn.escape_string(F.col("text")).alias("written"))
    return d.select("doc_id", "written", fn.to_hex(fn.parse_string(F.col("written"))).alias("back"))


@query("""select event_id, 'a' || chr(10) || 'b' || chr(9) || 'c(d)\\' || chr(cast(event_id % 64 + 64 as int)) || 'ef' || chr(10) || 'g' as back from events""")
def string_escapes(t):
    r"""Letters, octal codes of any length, broken lines, nested parentheses and CR in literal strings."""
    code = F.lpad(F.conv((F.col("event_id") % 64 + 64).cast("string"), 10, 8), 3, "0")
    text = F.concat(F.lit("(a\\nb\\tc(d)\\\\\\"), code, F.lit("e\\\r\nf\rg)"))
    return t("events").select("event_id", F.decode(fn.parse_string(text), "UTF-8").alias("back"))


@query("""select doc_id, regexp_replace(lower(hex(encode(text))), '(.{70})', '\\1' || chr(10), 'g') as shown from documents where octet_length(encode(text)) % 35 > 0
union all select doc_id, regexp_replace(regexp_replace(lower(hex(encode(text))), '(.{70})', '\\1' || chr(10), 'g'), '.$', '', 's') from documents where octet_length(encode(text)) % 35 = 0""")
def hex_lines(t):
    return t("documents").select("doc_id", fn.hex_lines(F.col("text")).alias("shown"))


@query("""select o_orderkey, cast(o_orderkey as int) as num, cast(o_orderkey % 7 as int) as gen, o_orderkey as zeros, -1 as word, case when o_orderkey % 2 = 0 then o_orderkey % 256 else o_orderkey % 65536 end as big from orders""")
def parsed_numbers(t):
    """References, numbers with zeros in front, words that aren't numbers, and big-endian bytes."""
    k = F.col("o_orderkey")
    ref = fn.parse_reference(F.concat_ws(" ", k.cast("string"), (k % 7).cast("string"), F.lit("R")))
    zeros = fn.digits_or_minus_one(F.lpad(k.cast("string"), 10, "0"))
    raw = F.unhex(F.lpad(F.hex(k), 16, "0"))
    big = fn.big_endian(F.substring(raw, F.when(k % 2 == 0, 8).otherwise(7), F.lit(8))).cast("long")
    return t("orders").select("o_orderkey", ref["num"].alias("num"), ref["gen"].alias("gen"), zeros.alias("zeros"), fn.digits_or_minus_one(F.col("o_orderpriority")).cast("int").alias("word"), big.alias("big"))


@query("""select doc_id, cast(len(list_filter(string_split(text, '. '), x -> x <> '')) as bigint) as parts, cast(len(string_split(text, '. ')) as bigint) as all_parts, array_to_string(list_filter(string_split(text, '. '), x -> x <> ''), '|') as joined from documents""".replace("x -> ", "lambda x: "))
def split_exact(t):
    p, every = fn.split_exact(F.col("text"), ". "), fn.split_exact(F.col("text"), ". ", keep_empty=True)
    return t("documents").select("doc_id", F.size(p).cast("long").alias("parts"), F.size(every).cast("long").alias("all_parts"), F.array_join(p, "|").alias("joined"))


@query("""select doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)(the|th|e|on|.)'), lambda c: case c when 'the' then '<1>' when 'th' then 'TH' when 'e' then 'the' when 'on' then '' else c end), '') as changed from documents""")
def replaced_in_one_pass(t):
    pairs = [("the", "<1>"), ("th", "TH"), ("e", "the"), ("on", "")]
    return t("documents").select("doc_id", fn.replace_first_match(F.col("text"), pairs).alias("changed"))


@query("""select page_id, case when page_id % 2 = 0 then '/' || url else 'base/dir/' || url end as joined, 'base/dir/' || regexp_replace(case when page_id % 2 = 0 then '/' || url else url end, '^/+', '') as below,
case when contains(url, '.') then regexp_extract(url, '^(.*)\\.[^.]*$', 1) else url end as stem from pages""")
def joined_paths(t):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), "url")).otherwise(F.col("url"))
    base = F.lit("base/dir//")
    return t("pages").select("page_id", fn.join_path(base, u).alias("joined"), fn.join_path_below(base, u).alias("below"), fn.extension(F.col("url"))["stem"].alias("stem"))


@query("""select doc_id, lower(substr(hex(encode(text)), 3, 8)) as inner_part, lower(right(hex(encode(text)), 12)) as tail, sha256(encode(text) || encode('x')) as sha from documents""")
def byte_ranges(t):
    b = F.col("text").cast("binary")
    return t("documents").select("doc_id", fn.to_hex(fn.byte_range(b, 1, 4)).alias("inner_part"), fn.to_hex(fn.byte_range(b, -6)).alias("tail"), F.hex(fn.sha256_bytes(F.concat(b, F.lit(b"x")))).alias("s")).select("doc_id", "inner_part", "tail", F.lower("s").alias("sha"))


@query("""with b as (select event_id, lpad(md5(cast(event_id as varchar)), 32, '0') as h from events),
l as (select event_id, list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as int)) as v from b),
n as (select event_id, list_transform(regexp_extract_all(h, '.'), lambda x: cast('0x' || x as int)) as v from b)
select l.event_id, cast(list_sum(list_transform(range(16), lambda i: l.v[i + 1] * (i + 1))) as bigint) as eight, cast(list_sum(list_transform(range(32), lambda i: n.v[i + 1] * (i + 1))) as bigint) as four,
cast(list_sum(list_transform(range(64), lambda i: ((n.v[i // 2 + 1] >> cast(2 - 2 * (i % 2) as int)) & 3) * (i + 1))) as bigint) as two, cast(list_sum(list_transform(range(128), lambda i: ((n.v[i // 4 + 1] >> cast(3 - i % 4 as int)) & 1) * (i + 1))) as bigint) as one,
cast(list_sum(list_transform(range(8), lambda i: (l.v[2 * i + 1] * 256 + l.v[2 * i + 2]) * (i + 1))) as bigint) as sixteen, true as back from l join n on l.event_id = n.event_id""")
def packed_samples(t):
    """Samples of all widths unpacked from 16 bytes (weighted sums show their order), and packed again."""
    b = F.unhex(F.md5(F.col("event_id").cast("string")))
    widths = {"one": 1, "two": 2, "four": 4, "eight": 8, "sixteen": 16}
    e = t("events").select("event_id", b.alias("b"), *[fn.unpack_bits(b, w, 128 // w).alias(k) for k, w in widths.items()])
    total = lambda c: F.aggregate(F.transform(c, lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    back = [fn.pack_bits(F.col(k), w) == F.col("b") for k, w in widths.items()]
    return e.select("event_id", *[total(F.col(k)).alias(k) for k in widths], (back[0] & back[1] & back[2] & back[3] & back[4]).alias("back"))


@query("""select event_id, -1.0 + least(greatest(cast(floor(value) as int), 0), 255) * 3.0 / 255 as line, least(greatest(floor(0.5 + (least(greatest(value, 0), 200.0)) * 15 / 200.0), 0), 15)::int as sample,
true as inside from events""")
def interpolated(t):
    """Samples on a line of values, and values as samples of four bits through pairs of ranges."""
    v = F.col("value")
    sample = fn.encode_samples(F.array(F.least(F.greatest(v, F.lit(0.0)), F.lit(200.0)), F.lit(1.0)), 4, [(0.0, 200.0), (0.0, 1.0)])
    back = fn.decode_samples(sample, 4, [(0.0, 200.0), (0.0, 1.0)])
    near = (F.abs(F.get(back, 0) - F.least(F.greatest(v, F.lit(0.0)), F.lit(200.0))) <= 200.0 / 30 + 1e-9) & (F.get(back, 1) == 1.0)
    return t("events").select("event_id", fn.interpolate(F.floor("value").cast("int"), 255, -1.0, 2.0).alias("line"), F.get(sample, 0).alias("sample"), near.alias("inside"))


@query("""with b as (select user_id, list(case when event_type = 'click' then 1 else 0 end order by event_id) as bits from events group by user_id)
select user_id, lower(array_to_string(list_transform(regexp_extract_all(rpad(array_to_string(list_transform(bits, lambda x: 1 - x), ''), cast(ceil(len(bits) / 8.0) * 8 as int), '0'), '.{8}'), lambda x: printf('%02x', cast(list_reduce(list_transform(string_split(x, ''), lambda c: cast(c as int)), lambda p, q: p * 2 + q) as int))), '')) as inverted,
array_to_string(bits, '') as back, cast(len(bits) as int) as total from b""")
def inverted_rows(t):
    """Packed rows complemented; change positions back to bits; runs that add up to the width."""
    e = t("events").select("user_id", F.struct("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("b")).alias("e"))
    b = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["b"]).alias("bits"))
    changes = fn.change_positions(F.col("bits"))
    total = F.aggregate(fn.run_lengths(changes), F.lit(0), lambda a, x: a + x)
    return b.select("user_id", fn.to_hex(fn.invert_bits(fn.pack_bits(F.col("bits"), 1), F.size("bits"))).alias("inverted"), F.array_join(fn.bits_of_changes(changes), "").alias("back"), total.alias("total"))


@query("""select p_partkey, k as kind, case k when 'DeviceGray' then 1 when 'CalGray' then 1 when 'Indexed' then 1 when 'DeviceRGB' then 3 when 'CalRGB' then 3 when 'Lab' then 3 when 'DeviceCMYK' then 4 when 'ICCBased' then cast(p_size % 4 + 1 as int) end as n,
case when k = 'ICCBased' then array_to_string(list_transform(range(2 * (p_size % 4 + 1)), lambda i: cast(cast(i % 2 as double) as varchar)), ',') end as icc
from (select p_partkey, p_size, ['DeviceGray', 'CalGray', 'Indexed', 'DeviceRGB', 'CalRGB', 'Lab', 'DeviceCMYK', 'ICCBased', 'Pattern'][p_partkey % 9 + 1] as k from part)""")
def colour_components(t):
    kinds = ["DeviceGray", "CalGray", "Indexed", "DeviceRGB", "CalRGB", "Lab", "DeviceCMYK", "ICCBased", "Pattern"]
    k, n = F.get(F.array(*[F.lit(x) for x in kinds]), (F.col("p_partkey") % 9).cast("int")), (F.col("p_size") % 4 + 1).cast("int")
    icc = F.when(k == "ICCBased", F.array_join(colour.icc_range(n, F.lit(None).cast("array<double>")).cast("array<string>"), ","))
    return t("part").select("p_partkey", k.alias("kind"), colour.component_count(k, n).alias("n"), icc.alias("icc"))


@query("""select p_partkey, ['CalGray', 'CalRGB', 'Lab'][p_partkey % 3 + 1] as kind, p_size / 100.0::double as white, case when p_size % 2 = 0 then p_size / 50.0::double else 0.0 end as black,
case p_partkey % 3 when 0 then '1.0' when 1 then '1.0,1.0,1.0' end as gamma, case p_partkey % 3 when 1 then '1.0,0.0,0.0,0.0,1.0,0.0,0.0,0.0,1.0' end as matrix, case p_partkey % 3 when 2 then '-100.0,100.0,-100.0,100.0' end as range,
'["/' || ['CalGray', 'CalRGB', 'Lab'][p_partkey % 3 + 1] || '",{"WhitePoint":[' || cast(p_size / 100.0::double as varchar) || ',1.0,0.5]' || case when p_size % 2 = 0 then ',"BlackPoint":[' || cast(p_size / 50.0::double as varchar) || ',0.0,0.0]' else '' end || '}]' as written from part""")
def cie_spaces(t):
    kind = F.get(F.array(F.lit("CalGray"), F.lit("CalRGB"), F.lit("Lab")), (F.col("p_partkey") % 3).cast("int"))
    none = F.lit(None).cast("array<double>")
    black = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_size") / 50.0, F.lit(0.0), F.lit(0.0)))
    p = t("part").select("p_partkey", kind.alias("kind"), colour.cie_parameters(kind, F.array(F.col("p_size") / 100.0, F.lit(1.0), F.lit(0.5)), black, none, none, none).alias("p"))
    text = lambda c: F.array_join(F.col(f"p.{c}").cast("array<string>"), ",").alias(c)
    return p.select("p_partkey", "kind", F.get("p.white", 0).alias("white"), F.get("p.black", 0).alias("black"), text("gamma"), text("matrix"), text("range"), colour.cie_to_json(F.col("kind"), F.col("p")).alias("written"))


@query("""with p as (select p_partkey, md5(p_name) || md5(p_brand) as h, p_size % 12 as place from part)
select p_partkey, substr(h, cast(least(place, 9) * 6 + 1 as int), 6) as colour, '["/Indexed","/DeviceRGB",9,"<' || left(h, 60) || '>"]' as written,
cast(p_partkey % 5 as float) as x0, cast(p_partkey % 7 + 0.5 as float) as y1 from p""")
def palettes(t):
    """Colours looked up in a palette of ten, the palette written, and rectangles of four numbers."""
    h = F.concat(F.md5("p_name"), F.md5("p_brand"))
    raw = F.substring(F.unhex(h), 1, 30)
    box = colour.rect(F.array(F.col("p_partkey") % 5, F.lit(0), F.lit(100), F.col("p_partkey") % 7 + F.lit(0.5)))
    return t("part").select("p_partkey", fn.to_hex(colour.palette_colour(raw, F.col("p_size") % 12, F.lit(3), F.lit(9))).alias("colour"), colour.indexed_to_json(F.lit("DeviceRGB"), raw, F.lit(3)).alias("written"), F.get(box, 0).alias("x0"), F.get(box, 3).alias("y1"))


@query("""select event_id, cast(props->>'$.k' as int) as k, event_type as second, case when event_id % 2 = 0 then 'u' || user_id end as put, event_id % 3 <> 0 as held,
'event,k,n' as merged, cast(props->>'$.none' as int) is null as missing, event_type as ensured from events""")
def dictionary_edits(t):
    """Array elements, entries put, replaced and dropped, dictionaries merged, null objects, names that must be one value."""
    e = t("events").withColumn("m", F.from_json("props", "map<string,string>"))
    put = fn.map_put(F.col("m"), "u", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    kept = F.when(F.col("event_id") % 3 == 0, fn.map_drop(F.col("m"), "k")).otherwise(fn.map_replace(F.col("m"), "k", F.lit("9")))
    merged = fn.map_merge(F.col("m"), F.create_map(F.lit("n"), F.lit("1"), F.lit("event"), F.col("event_type")))
    v = F.parse_json("props")
    ensured = F.when(F.col("event_type") == "click", fn.ensure(F.col("event_type"), "click")).otherwise(F.col("event_type"))
    return e.select(
        "event_id", fn.get_required(v, "$.k", "int").alias("k"), fn.element(F.array("props", "event_type"), 1).alias("second"), put["u"].alias("put"),
        F.map_contains_key(kept, "k").alias("held"), F.array_join(F.array_sort(F.map_keys(merged)), ",").alias("merged"),
        fn.is_null_object(F.try_variant_get(v, "$.none", "variant")).alias("missing"), ensured.alias("ensured"),
    )


@query("""select doc_id, sha256(text) as padded, sha256(text) as given, sha256(text) as raw, sha256(text) as rc4 from documents""")
def ciphers_round_trip(t):
    """Whole texts through AES with padding under each object's key, with a given IV, raw blocks, and RC4."""
    b = F.col("text").cast("binary")
    key, iv = fn.object_key(fn.md5_bytes(F.col("lang")), F.col("doc_id"), F.lit(0), aes=True), fn.md5_bytes(F.col("source"))
    blocks = F.rpad(b, (F.ceil((F.octet_length("text") + 1) / 16) * 16).cast("int"), b"\x00")
    d = t("documents").select("doc_id", F.octet_length("text").alias("n"), F.aes_encrypt(b, key, F.lit("CBC"), F.lit("PKCS")).alias("p"), fn.aes_cbc_encrypt(b, key, iv).alias("g"), fn.aes_cbc_raw_encrypt(blocks, key, iv).alias("r"), columns.rc4(b, key).alias("s"), key.alias("key"), iv.alias("iv"))
    raw = F.substring(fn.aes_cbc_raw_decrypt(F.col("r"), F.col("key"), F.col("iv")), F.lit(1), F.col("n"))
    return d.select("doc_id", F.sha2(fn.aes_cbc_decrypt(F.col("p"), F.col("key")), 256).alias("padded"), F.sha2(fn.aes_cbc_decrypt(F.col("g"), F.col("key")), 256).alias("given"), F.sha2(raw, 256).alias("raw"), F.sha2(columns.rc4(F.col("s"), F.col("key")), 256).alias("rc4"))


@query("""select c_custkey, 'n' || c_nationkey as at from customer union all select 100000000 + n_nationkey, 'r' || n_regionkey from nation union all select 200000000 + s_suppkey, null from supplier""")
def followed_chains(t):
    """Chains of references: customers to their nation, nations to their region, suppliers round a cycle."""
    ref = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    c, n, s = t("customer"), t("nation"), t("supplier")
    refs = c.select(F.col("c_custkey").alias("id"), ref("c", "c_custkey").alias("at")).union(n.select(F.col("n_nationkey") + 100000000, ref("m", "n_nationkey"))).union(s.select(F.col("s_suppkey") + 200000000, ref("s", "s_suppkey")))
    links = c.select(ref("c", "c_custkey").alias("at"), ref("n", "c_nationkey").alias("next")).union(n.select(ref("m", "n_nationkey"), ref("r", "n_regionkey")))
    links = links.union(s.select(ref("s", "s_suppkey"), F.concat(F.lit("s"), (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(-1)).cast("string"))))
    return graph.follow(refs, links).select(F.col("id").cast("long").alias("c_custkey"), "at")


@query("""with e as (select user_id, event_id % 50 as num, (event_id // 50) % 3 as gen, event_id, case when event_id % 11 = 0 then 'c' else 'n' end as type from events),
n as (select user_id, num, arg_max(type, event_id) as type, arg_max(gen, event_id) as gen, max(event_id) as event_id from e group by user_id, num),
g as (select user_id, num, max(gen * 1000000000000 + event_id) as top from e where type <> 'c' group by user_id, num)
select n.user_id, n.num, case when n.type = 'c' or top is null then n.event_id else top % 1000000000000 end as event_id from n left join g on g.user_id = n.user_id and g.num = n.num""")
def xref_precedence(t):
    """Entries by generation and age; the newest stays if it is inside an object stream."""
    e = t("events").select("user_id", (F.col("event_id") % 50).alias("num"), (F.floor(F.col("event_id") / 50) % 3).alias("gen"), "event_id", F.when(F.col("event_id") % 11 == 0, "c").otherwise("n").alias("type"))
    # the order stays in the entry under another name
    return graph.newest_entries(e.withColumn("age", F.col("event_id")), ["user_id", "num"], "age", "gen", "type").select("user_id", "num", "event_id")


@query("""with p as (select distinct left(rpad(p_name, 12, '.'), 12) as prefix from part where p_partkey % 3 = 0), h as (select distinct p_name from part where p_size > 25)
select p_partkey, case when left(rpad(p_name, 12, '.'), 12) in (select prefix from p) then 12::bigint when p_name in (select p_name from h) then 200 else -1 end as prefix_length from part""")
def prefix_hosts(t):
    """Prefixes of a whole name's length count only where no other one matches."""
    names = t("part").withColumn("name", F.rpad("p_name", 200, "."))
    p = names.where("p_partkey % 3 = 0").select(F.substring("name", 1, 12).alias("prefix")).union(names.where("p_size > 25").select("name")).distinct()
    return graph.longest_prefix(names, F.col("name"), p, host_length=200).select("p_partkey", "prefix_length")


@query("""select user_id, event_id, cast(floor(value) as bigint) % 256 as sample from events where value >= 0""")
def predictor_up_decode(t):
    """Differences down each user's column, and the samples back."""
    e = t("events").where("value >= 0").select("user_id", "event_id", (F.floor("value") % 256).alias("x"))
    coded = e.withColumn("code", rows.sub_encode(F.col("x"), rows.over(["user_id"], ["event_id"])))
    return coded.select("user_id", "event_id", rows.up_decode(F.col("code"), "event_id", ["user_id"]).cast("long").alias("sample"))


@query("""select l_orderkey, array_to_string(list(cast(l_quantity as int) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax), ',') as samples from lineitem group by l_orderkey""")
def predictor_folds(t):
    """Lines coded by average and by Paeth against a line above, and both decoded."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"]
    s = t("lineitem").withColumn("x", F.col("l_quantity").cast("int")).withColumn("up", F.round(F.col("l_tax") * 100).cast("int"))
    r = rows.predicted(F.col("x"), F.col("up"), rows.over(["l_orderkey"], order))
    s = s.select("l_orderkey", F.struct(*order, "up", r["average"].alias("a"), r["paeth"].alias("p")).alias("e"))
    g = s.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("l"))
    of = lambda c: F.transform("l", lambda x: x[c])
    d = g.select("l_orderkey", rows.average_decode(of("a"), of("up")).alias("a"), rows.paeth_decode(of("p"), of("up")).alias("p"))
    return d.select("l_orderkey", F.when(F.col("a") == F.col("p"), F.array_join("a", ",")).alias("samples"))


@query("select doc_id, text as back from documents")
def delimited_text(t):
    """Texts written one after another with a delimiter that they don't hold, and read up to it."""
    d = t("documents")
    path = shared_path(d.sparkSession, "delimited")
    lines.write_delimited(d.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text")), path, "\x1e\x1f")
    back = lines.delimited(d.sparkSession, path, "\x1e\x1f")
    return back.select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("back"))


@query("""select doc_id, printf('%s|%05d|%.2f|%x', source, n_chars, n_chars / 7.0::double, n_chars) as shown from documents""")
def formatted(t):
    return t("documents").select("doc_id", F.format_string("%s|%05d|%.2f|%x", "source", "n_chars", F.col("n_chars") / 7.0, "n_chars").alias("shown"))
