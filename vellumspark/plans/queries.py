"""Queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark import functions as fn
from vellumspark.operators import graph, rows
from vellumspark.plans.registry import query

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"]


NODES_SQL = """edges as (
  select 'o' || o_orderkey as src, 'c' || o_custkey as dst from orders
  union all select 'c' || c_custkey, 'n' || c_nationkey from customer
  union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
  union all select 'r' || n_regionkey, 'n' || min(n_nationkey) from nation group by n_regionkey),
reached(root, node) as (
  select 'c' || c_custkey, 'c' || c_custkey from customer
  union select reached.root, edges.dst from reached join edges on reached.node = edges.src)"""


def _edges(t) -> DataFrame:
    ref = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    out = t("orders").select(ref("o", "o_orderkey").alias("src"), ref("c", "o_custkey").alias("dst"))
    out = out.union(t("customer").select(ref("c", "c_custkey"), ref("n", "c_nationkey")))
    out = out.union(t("nation").select(ref("n", "n_nationkey"), ref("r", "n_regionkey")))
    # a reference back up makes cycles
    back = t("nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    return out.union(back.select(ref("r", "n_regionkey"), ref("n", "k")))


def _reached(t) -> DataFrame:
    me = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return graph.closure(_edges(t), t("customer").select(me.alias("root"), me.alias("node")))


@query(f"with recursive {NODES_SQL} select root, node from reached")
def closure_reachable(t):
    return _reached(t)


@query(f"""with recursive {NODES_SQL}, ids as (select root, node, row_number() over (partition by root order by node) as new_id from reached)
select a.root, a.new_id as src, b.new_id as dst from edges e join ids a on a.node = e.src join ids b on b.root = a.root and b.node = e.dst""")
def closure_remap(t):
    return graph.renumber_edges(_edges(t), graph.number(_reached(t)))


@query("""select o_orderkey, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def deref_order_customer(t):
    out = graph.dereference(t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"], ["o_custkey"])
    out = graph.dereference(out, t("nation"), ["n_nationkey"], ["c_nationkey"])
    return graph.dereference(out, t("region"), ["r_regionkey"], ["n_regionkey"]).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""with n as (select n_nationkey, n_regionkey, case when n_nationkey % 2 = 0 then n_nationkey end as rotate, case when n_nationkey % 3 = 0 then n_name end as box from nation),
r as (select r_regionkey, r_regionkey * 90 as rotate, r_name as box from region)
select c_custkey, coalesce(case when c_custkey % 5 = 0 then cast(c_custkey as int) end, n.rotate, r.rotate) as rotate,
coalesce(case when c_custkey % 7 = 0 then c_name end, n.box, r.box) as box
from customer left join n on c_nationkey = n_nationkey left join r on n_regionkey = r_regionkey""")
def inherit_attr(t):
    r = t("region").select("r_regionkey", (F.col("r_regionkey") * 90).alias("rotate"), F.col("r_name").alias("box"))
    n = t("nation").select("n_nationkey", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("rotate"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("box"))
    c = t("customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey").cast("int")).alias("rotate"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).alias("box"))
    return graph.inherit([r, n, c], ["n_regionkey", "c_nationkey"], ["r_regionkey", "n_nationkey", "c_custkey"], ["rotate", "box"])


@query("select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def visited_anti(t):
    return t("orders").select("o_orderkey", "o_orderstatus").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""with p as (select distinct substr(p_brand, 1, k) as prefix from part, (values (6), (7), (8)) v(k) where k < 8 or p_size > 25)
select p_partkey, arg_max(prefix, length(prefix)) as prefix, coalesce(max(length(prefix)), -1) as prefix_length
from part left join p on starts_with(p_brand || ' ' || p_name, prefix) group by p_partkey""")
def prefix_match(t):
    k = F.explode(F.array(F.lit(6), F.lit(7), F.lit(8)))
    p = t("part").select("p_brand", "p_size", k.alias("k")).where("k < 8 or p_size > 25").select(F.col("p_brand").substr(F.lit(1), F.col("k")).alias("prefix")).distinct()
    return graph.longest_prefix(t("part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("t")), F.col("t"), p).select("p_partkey", "prefix", "prefix_length")


@query("select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as end_off from orders")
def xref_ends(t):
    return rows.ends(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "end_off")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(props, event_id) as props from events group by user_id")
def xref_newest(t):
    return graph.newest_entries(t("events").select("user_id", "event_id", "event_type", "props"), ["user_id"], "event_id")


@query("""select o_orderkey, expected, coalesce(found, 0) as found, expected = coalesce(found, 0) as matches
from (select o_orderkey, cast(1 + o_orderkey % 7 as bigint) as expected from orders) left join (select l_orderkey, count(*) as found from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def count_check(t):
    stored = t("orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("expected"))
    return graph.count_mismatches(t("lineitem").select("l_orderkey"), "l_orderkey", stored, "o_orderkey", "expected")


@query("select count(*) as pages, count(distinct o_custkey) as documents, cast(sum(octet_length(encode(o_orderpriority))) as bigint) as bytes from orders")
def page_count(t):
    return t("orders").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("o_custkey").alias("documents"), F.sum(F.octet_length("o_orderpriority")).alias("bytes"))


@query("select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as page_no from orders) where page_no between 2 and 4")
def page_slice(t):
    return rows.page_slice(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2, 3)


@query("""select key, name, file_no, row_number() over (partition by file_no order by key) as page_no from
(select c_custkey as key, c_name as name, 1 as file_no from customer union all select s_suppkey, s_name, 2 from supplier)""")
def page_merge(t):
    files = [t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))]
    return rows.merge(files, ["key"])


@query("select p_brand, p_partkey, p_name from (select *, row_number() over (partition by p_brand order by p_partkey) as n from part where p_size < 10) where n = 1")
def first_match(t):
    return rows.first_match(t("part").where("p_size < 10").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])


@query("select p_brand, p_partkey, row_number() over (partition by p_brand order by upper(p_name), p_partkey) as place from part")
def nocase_order(t):
    return rows.numbered(t("part"), ["p_brand"], [F.upper("p_name"), F.col("p_partkey")], "place").select("p_brand", "p_partkey", "place")


ORDER_SQL = ", ".join(LINE)
SAMPLES_SQL = f"""s as (select *, cast(l_quantity as int) as x, cast(round(l_tax * 100) as int) as up from lineitem),
w as (select *, lag(x, 1, 0) over o as lft, lag(up, 1, 0) over o as corner from s window o as (partition by l_orderkey order by {ORDER_SQL})),
g as (select *, 0 as g0, lft as g1, up as g2, (lft + up) // 2 as g3,
  case when abs(up - corner) <= abs(lft - corner) and abs(up - corner) <= abs(lft + up - 2 * corner) then lft when abs(lft - corner) <= abs(lft + up - 2 * corner) then up else corner end as g4 from w)"""


def _samples(t) -> DataFrame:
    s = t("lineitem").select("l_orderkey", *LINE).withColumn("x", F.col("l_quantity").cast("int")).withColumn("up", F.round(F.col("l_tax") * 100).cast("int"))
    r = rows.predicted(F.col("x"), F.col("up"), rows.over(["l_orderkey"], LINE))
    return s.select("l_orderkey", *LINE, "x", *[v.alias(k) for k, v in r.items()])


KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"with {SAMPLES_SQL} select {KEY_SQL}, x, ((x - g1) % 256 + 256) % 256 as code from g")
def predictor_sub(t):
    return _samples(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", F.col("sub").alias("code"))


@query(f"with {SAMPLES_SQL} select {KEY_SQL}, x, cast(sum(((x - g1) % 256 + 256) % 256) over (partition by l_orderkey order by {ORDER_SQL}) % 256 as bigint) as decoded from g")
def predictor_sub_decode(t):
    d = _samples(t).withColumn("decoded", rows.sub_decode(F.col("sub"), ["l_orderkey"], LINE).cast("long"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "decoded")


@query("""select user_id, event_id, ((x - lag(x, 1, 0) over (partition by user_id order by event_id)) % 256 + 256) % 256 as code
from (select user_id, event_id, cast(floor(value) as bigint) as x from events)""")
def predictor_up(t):
    e = t("events").select("user_id", "event_id", F.floor("value").alias("x"))
    return e.select("user_id", "event_id", rows.sub_encode(F.col("x"), rows.over(["user_id"], ["event_id"])).alias("code"))


@query(f"with {SAMPLES_SQL} select {KEY_SQL}, ((x - g3) % 256 + 256) % 256 as average, ((x - g4) % 256 + 256) % 256 as paeth from g")
def predictor_paeth(t):
    return _samples(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "average", "paeth")


COST_SQL = ", ".join(f"sum(least(((x - g{i}) % 256 + 256) % 256, 256 - ((x - g{i}) % 256 + 256) % 256)) as c{i}" for i in range(5))


@query(f"""with {SAMPLES_SQL}, c as (select l_orderkey, {COST_SQL} from g group by l_orderkey)
select l_orderkey, case least(c0, c1, c2, c3, c4) when c0 then 0 when c1 then 1 when c2 then 2 when c3 then 3 else 4 end as filter, cast(least(c0, c1, c2, c3, c4) as bigint) as cost from c""")
def best_filter(t):
    return rows.best_filter(_samples(t), ["l_orderkey"], {k: k for k in rows.FILTERS})


@query("""with m as (select user_id, event_id, event_type, case when lag(event_type) over w is not distinct from event_type and row_number() over w > 1 then 0 else 1 end as s
from events window w as (partition by user_id order by event_id)),
r as (select user_id, event_type, sum(s) over (partition by user_id order by event_id) as run from m)
select user_id, cast(run as bigint) as run, event_type, count(*) as length from r group by user_id, run, event_type""")
def run_lengths(t):
    return rows.runs(t("events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("""with b as (select user_id, list(case when event_type = 'click' then 1 else 0 end order by event_id) as bits from events group by user_id)
select user_id, array_to_string(list_filter(list_transform(range(len(bits)), lambda i: case when bits[i + 1] <> coalesce(case when i > 0 then bits[i] end, 0) then i end), lambda x: x is not null) || [len(bits)], ',') as changes,
lower(array_to_string(list_transform(regexp_extract_all(rpad(array_to_string(bits, ''), cast(ceil(len(bits) / 8.0) * 8 as int), '0'), '.{8}'), lambda x: printf('%02x', cast(list_reduce(list_transform(string_split(x, ''), lambda c: cast(c as int)), lambda p, q: p * 2 + q) as int))), '')) as packed
from b""")
def bitmap_rows(t):
    e = t("events").select("user_id", F.struct("event_id", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("b")).alias("e"))
    b = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["b"]).alias("bits"))
    return b.select("user_id", F.array_join(fn.change_positions(F.col("bits")), ",").alias("changes"), fn.to_hex(fn.pack_bits(F.col("bits"), 1)).alias("packed"))


@query("select doc_id, lower(hex(encode(text))) as digits from documents")
def hex_encode(t):
    return t("documents").select("doc_id", fn.to_hex(F.col("text")).alias("digits"))


@query("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def md5_sha256(t):
    return t("documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""select doc_id, left(md5(unhex(left(md5(lang), 10)) || unhex(printf('%02x%02x%02x', doc_id & 255, (doc_id >> 8) & 255, (doc_id >> 16) & 255)) || unhex(printf('%02x%02x', n_chars & 255, (n_chars >> 8) & 255))), 20) as key_rc4,
md5(unhex(md5(lang)) || unhex(printf('%02x%02x%02x', doc_id & 255, (doc_id >> 8) & 255, (doc_id >> 16) & 255)) || unhex(printf('%02x%02x', n_chars & 255, (n_chars >> 8) & 255)) || encode('sAlT')) as key_aes from documents""")
def object_key(t):
    k = fn.md5_bytes(F.col("lang"))
    short = fn.object_key(F.substring(k, 1, 5), F.col("doc_id"), F.col("n_chars"))
    return t("documents").select("doc_id", fn.to_hex(short).alias("key_rc4"), fn.to_hex(fn.object_key(k, F.col("doc_id"), F.col("n_chars"), aes=True)).alias("key_aes"))


@query("""select doc_id, cast(octet_length(encode(text)) as bigint) as n_bytes, cast(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as int))) as bigint) as total from documents""")
def byte_sum(t):
    each = F.transform(F.regexp_extract_all(F.hex("text"), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("select event_id, cast(least(greatest(floor(0.5 + (value - 0.0) * 255 / (200.0 - 0.0)), 0), 255) as int) as sample from events")
def quantize(t):
    return t("events").select("event_id", fn.quantize(F.col("value"), 255, 0.0, 200.0).alias("sample"))


@query(f"""select {KEY_SQL}, cast((255 - k) * (255 - c) // 255 as bigint) as r, (255 - k) * (255 - m) // 255 as g, (255 - k) * (255 - y) // 255 as b from
(select *, least(greatest(cast(l_quantity as int) * 6 - 20, 0), 255) as c, l_partkey % 256 as m, l_suppkey % 256 as y, l_linenumber * 30 as k from lineitem)""")
def clamp_cmyk(t):
    c = fn.clamp_byte(F.col("l_quantity").cast("int") * 6 - 20)
    rgb = fn.cmyk_to_rgb(c, F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber") * 30)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rgb.alias("rgb")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col("rgb")[x].cast("long").alias(x) for x in "rgb"])


@query("""select doc_id, len(p) as parts, p[1] as first, p[-1] as last from (select doc_id, list_filter(regexp_split_to_array(text, '[ ,.\\n]'), lambda x: x <> '') as p from documents)""")
def str_split_nonempty(t):
    p = t("documents").select("doc_id", fn.split_any(F.col("text"), " ,.\n").alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("parts"), F.get("p", F.lit(0)).alias("first"), F.try_element_at("p", F.lit(-1)).alias("last"))


@query("select o_orderkey, cast(coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), 1) - 1 as int) as place from orders")
def names_index(t):
    return t("orders").select("o_orderkey", fn.name_index(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).alias("place"))


@query("""select page_id, case when regexp_full_match(url, '/+') then '/' else regexp_extract(url, '([^/]*/*)$', 1) end as base,
case when not regexp_matches(url, '/+[^/]') then regexp_replace(url, '/+$', '') else regexp_extract(url, '^(.*?)/*[^/]*/*$', 1) end as dir,
case when contains(url, '.') then regexp_extract(url, '\\.([^.]*)$', 1) else '' end as ext from pages""")
def path_parts(t):
    return t("pages").select("page_id", fn.base_name(F.col("url")).alias("base"), fn.dir_name(F.col("url")).alias("dir"), fn.extension(F.col("url"))["ext"].alias("ext"))


@query("""select doc_id, case when n // 1024 > 1024 then case when n // 1048576 > 1024 then (n // 1073741824) || 'G' else (n // 1048576) || 'M' end else greatest(n // 1024, 1) || 'K' end as size
from (select doc_id, n_chars * n_chars * 10 as n from documents)""")
def human_size(t):
    return t("documents").select("doc_id", fn.human_size(F.col("n_chars") * F.col("n_chars") * 10).alias("size"))


@query("select doc_id, regexp_full_match(text[1:256], '[\\x20-\\x7e\\s]*') as printable from documents")
def printable_prefix(t):
    return t("documents").select("doc_id", fn.printable(F.col("text")).alias("printable"))


@query("""with h as (select doc_id, lower(hex(encode(text))) as h from documents),
l as (select doc_id, i, substr(h, i * 32 + 1, 32) as seg from h, unnest(range((length(h) // 2 + 15) // 16)) as u(i) where length(h) > 0)
select doc_id, i as line_no, printf('%08x', i * 16) || '  ' || regexp_replace(rpad(regexp_replace(seg, '(..)', '\\1 ', 'g'), 48, ' '), '^(.{24})', '\\1 ') || ' ' ||
array_to_string(list_transform(regexp_extract_all(seg, '..'), lambda b: case when b between '20' and '7e' then chr(cast('0x' || b as int)) else '.' end), '') as line from l""")
def hexdump_rows(t):
    lines = t("documents").select("doc_id", F.posexplode(fn.hexdump(F.col("text").cast("binary"))).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""select event_id, cast(props->>'$.k' as int) as k, coalesce(try_cast(props->>'$.k' as int), -1) as lenient, coalesce(try_cast(props->>'$.none' as int), 7) as missing from events""")
def dict_get(t):
    v = F.parse_json("props")
    return t("events").select("event_id", fn.get_required(v, "$.k", "int").alias("k"), fn.get_lenient(v, "$.k", "int", -1).alias("lenient"), fn.get_strict(v, "$.none", "int", 7).alias("missing"))


@query("""with a as (select event_id, (event_id * 2654435761) % 4294967296 as ip, event_id % 33 as n from events)
select event_id, ip - ip % cast(2 ** (32 - n) as bigint) = (ip // 65536) * 65536 as inside, case when n % 5 = 0 then -1 else n end as mask_bits from a""")
def ip_prefixes(t):
    e = t("events").select("event_id", ((F.col("event_id") * 2654435761) % 4294967296).alias("ip"), (F.col("event_id") % 33).alias("n"))
    inside = fn.ip4_in_prefix(F.col("ip"), F.floor(F.col("ip") / 65536) * 65536, F.col("n"))
    left = F.lit(4294967296) - F.pow(F.lit(2.0), 32 - F.col("n")).cast("long")
    mask = F.when(F.col("n") % 5 == 0, F.lit(0xFF00FF00)).otherwise(left)
    return e.select("event_id", inside.alias("inside"), fn.mask_length(mask).cast("long").alias("mask_bits"))


@query("""with a as (select event_id, lower(md5(cast(event_id as varchar))) as h, event_id % 129 as n from events),
b as (select *, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(cast('0x' || c as int)), 4, '0')), '') as bits from a)
select event_id, substr(bits, 65, 64) = repeat('0', 64) or n <= 64 or not contains(substr(bits, 65, cast(n as int) - 64), '1') as inside, case when n % 4 = 0 then cast(n as int) when n = 1 then 1 else -1 end as mask_bits from b""")
def ip6_prefixes(t):
    """Addresses of 16 bytes against their own first half, and masks with and without gaps."""
    e = t("events").select("event_id", (F.col("event_id") % 129).cast("int").alias("n"), F.unhex(F.md5(F.col("event_id").cast("string"))).alias("ip"))
    ones = lambda n: F.concat(F.repeat(F.lit("1"), n), F.repeat(F.lit("0"), 128 - n))
    text = F.when(F.col("n") % 4 == 0, ones(F.col("n"))).when(F.col("n") == 1, ones(F.lit(1))).otherwise(F.concat(F.lit("01"), F.repeat(F.lit("0"), F.lit(126))))
    mask = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(text, i * 4 + 1, F.lit(4)), 2, 16)), ""))
    # the first half of an address, as a prefix: it holds for lengths up to 64 once the address is cut there too
    prefix = F.concat(F.substring("ip", 1, 8), F.lit(bytes(8)))
    address = F.when(F.col("n") <= 64, prefix).otherwise(F.col("ip"))
    length = F.when(F.col("n") <= 64, F.lit(64)).otherwise(F.col("n"))
    return e.select("event_id", fn.ip6_in_prefix(address, prefix, length).alias("inside"), fn.mask_length(mask, 128).alias("mask_bits"))


@query("""select doc_id, case source when 'src1' then 9 when 'src2' then 4 else 0 end as place,
replace(replace(replace(replace(replace(replace(replace(replace(text, 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), ' ', '') as plain from documents""")
def switch_plain(t):
    return t("documents").select("doc_id", fn.switch(F.col("source"), {"src1": 9, "src2": 4}, 0).alias("place"), fn.pure_ascii(F.col("text")).alias("plain"))


@query("""select doc_id, source, printf('%010d %05d n ', coalesce(sum(octet_length(encode(text)) + 20) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) + 15, doc_id % 7) as line from documents""")
def xref_lines(t):
    """Entries of objects written one after another: offsets are running sums of their lengths."""
    d = t("documents").select("doc_id", "source", (F.octet_length("text") + 20).alias("n"))
    d = rows.running(d, ["source"], ["doc_id"], F.col("n"), "before")
    return d.select("doc_id", "source", F.regexp_replace(fn.xref_line(F.col("before") + 15, F.col("doc_id") % 7, F.lit("n")), "\n", "").alias("line"))


MACHINE = {("idle", "view"): "looking", ("looking", "click"): "busy", ("busy", "purchase"): "done", ("done", "view"): "looking", ("busy", "view"): "looking"}


@query("""select user_id, list_reduce(list_prepend('idle', list(event_type order by event_id)), lambda s, e: case when s = 'idle' and e = 'view' then 'looking'
when s = 'looking' and e = 'click' then 'busy' when s = 'busy' and e = 'purchase' then 'done' when s in ('done', 'busy') and e = 'view' then 'looking' else s end) as state from events group by user_id""")
def state_machine(t):
    return rows.final_state(t("events"), ["user_id"], "event_id", "event_type", MACHINE, "idle")


@query("select event_id, unnest(json_keys(props)) as key, length(props) as size from events")
def dict_iterate(t):
    """A row per entry of each dictionary."""
    e = t("events").select("event_id", "props", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return e.select("event_id", "key", F.length("props").cast("long").alias("size"))


@query("""select o_orderkey, (o_orderkey % 3 - 1.5::double) * (o_orderkey + 1) / 8 as value, regexp_replace(regexp_replace(printf('%.6f', (o_orderkey % 3 - 1.5::double) * (o_orderkey + 1) / 8), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') as shown
from orders""")
def number_round_trip(t):
    """Numbers with up to four decimals as text, and back."""
    n = (F.col("o_orderkey") % 3 - 1.5) * (F.col("o_orderkey") + 1) / 8
    shown = fn.print_number(n)
    return t("orders").select("o_orderkey", fn.parse_number(shown).alias("value"), shown.alias("shown"))


@query("""select doc_id, '/' || array_to_string(list_transform(string_split(text, ''), lambda c: case when c between '!' and '~' and not contains('()<>[]{}/%#', c) then c
else regexp_replace(hex(encode(c)), '(..)', '#\\1', 'g') end), '') as name, text as back from documents""")
def name_round_trip(t):
    """Whole texts as names, and read back."""
    d = t("documents").select("doc_id", fn.escape_name(F.col("text")).alias("name"))
    return d.select("doc_id", "name", fn.parse_name(F.col("name")).alias("back"))
