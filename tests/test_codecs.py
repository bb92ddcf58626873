import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.codecs import chain, columns, fax, lzw, predictor, text

# Bitmaps, their group 4 codes by an independent encoder, and their group 3 codes with end codes and fill (fixed values).
GOLDEN = [
    ("01111111 11111110", "23 8d 28 00 80 08", "000000000001000111000110000000000010011010100011000111000000000001000000000001000000000001000000000001000000000001000000000001000000000001000000"),
    ("10000000 00000001", "26 aa 2a 00 20 02", "0000000000010011010101011110000000000011111010000000000001000000000001000000000001000000000001000000000001000000000001000000000001000000"),
    ("10000000 00010000 00000010 10000000 00001000 00000001 00010000 00000001", "26 aa 25 d4 42 52 6a 86 26 14 54 c2 62 a0 02 00 20", "00000000000100110101010111100000000000110000101011000000000001111001000011100000000000100110101010111100000000000110110101000000000000001111101000000000000110000101011000000000001111101000000000000100000000000100000000000100000000000100000000000100000000000100000000000100"),
    ("11100011 00011010 00000000", "26 b0 50 60 aa 23 00 10 01", "000000000001001101011010001100000000000110001100011101000011100000000000110011000000000001000000000001000000000001000000000001000000000001000000000001000000000001000000"),
    ("11100011 00111111 00000010", "26 b0 50 c6 79 40 04 00 40", "0000000000010011010110100011000000000001011100100000000000011110010000111000000000001000000000001000000000001000000000001000000000001000000000001000000000001000"),
    ("11111111 00000111 00000010", "26 a2 9c 9a 80 08 00 80", "0000000000010011010100010100000000000111001000000000000111100100001110000000000010000000000010000000000010000000000010000000000010000000000010000000000010000000"),
    ("01100000 00111110 00000000", "23 f6 4c 71 80 08 00 80", "00000000000100011111110000000000000101110011000111000000000001100110000000000010000000000010000000000010000000000010000000000010000000000010000000000010"),
    ("000010100000 100011111110 000000000000", "36 88 ea 4d 54 49 8e 23 00 10 01", "00000000000110110100001110101100000000000001001101010101000000110001110000000000010010000000000000010000000000010000000000010000000000010000000000010000000000010000000000010000"),
    ("11110000 00001111 00100000", "26 ae 6d 84 56 00 08 00 80", "0000000000010011010101110110000000000011011011000000000001011101011000000000000010000000000010000000000010000000000010000000000010000000000010000000000010000000"),
    ("00001100 01010100", "37 c1 14 38 40 b0 01 00 10", "00000000000110111101110000000000010001110100001110100001110100111000000000001000000000001000000000001000000000001000000000001000000000001000000000001000"),
    ("00001000 11111110", "36 a4 d4 70 01 00 10", "000000000001101101010000000000000010011010100011000111000000000001000000000001000000000001000000000001000000000001000000000001000000000001000000"),
]


def bits(rows):
    return np.array([[int(c) for c in r] for r in rows.split()], np.uint8)


@pytest.mark.parametrize("rows,g4,g3", GOLDEN)
def test_golden_bitmaps(rows, g4, g3):
    b = bits(rows)
    assert fax.encode(b, -1).hex(" ") == g4
    assert (fax.decode(bytes.fromhex(g4), b.shape[1], -1) == b).all()
    assert fax.encode_bits(b, 0) == g3
    assert (fax.decode(int(g3, 2).to_bytes(len(g3) // 8, "big"), b.shape[1], 0) == b).all()


def test_fax_round_trips():
    r = np.random.default_rng(1)
    for width in (1, 7, 8, 9, 64, 1728, 2561, 6000):
        for p in (0.0, 0.02, 0.5, 1.0):
            b = (r.random((5, width)) < p).astype(np.uint8)
            for k in (-1, 0, 1, 4):
                assert (fax.decode(fax.encode(b, k), width, k) == b).all(), (width, p, k)


def samples():
    r = random.Random(2)
    yield from (b"", b"x", bytes(4097), b"-----A---B", bytes(range(256)) * 5)
    for n in (127, 128, 129):
        yield b"a" * n
        yield bytes(r.randrange(256) for _ in range(n))
    yield bytes(r.randrange(256) for _ in range(20000))
    yield b"".join(r.choice([b"ab", b"abc", b"\0\0\0\0", b"zz"]) for _ in range(9000))


@pytest.mark.parametrize("name", ["ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "LZWDecode", "FlateDecode"])
def test_round_trips(name):
    for d in samples():
        e = chain.encode_chain(d, [name])
        assert chain.decode_chain(e, [name]).data == d


@pytest.mark.parametrize("early", [0, 1])
def test_lzw_early_change(early):
    for d in samples():
        assert lzw.decode(lzw.encode(d, early), early) == d
    assert lzw.encode(b"-----A---B").hex() == "800b6050220c0c8501"  # the published example


def test_text_codecs():
    assert text.ahex_decode(b"4 1 4\n2 7>zz") == b"ABp"
    assert text.a85_decode(b"z!!~>") == bytes(5)
    with pytest.raises(text.CodecError):
        text.a85_decode(b"vvvvv~>")
    with pytest.raises(text.CodecError):
        text.runlength_decode(b"\x05ab")
    assert text.runlength_encode(b"aaaabc") == b"\xfda\x01bc\x80"


@pytest.mark.parametrize("bits_", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("colors", [1, 3, 4])
@pytest.mark.parametrize("kind", [2, 10, 11, 12, 13, 14, 15])
def test_predictors(bits_, colors, kind):
    r = random.Random(bits_)
    columns_ = 13
    size = (bits_ * colors * columns_ + 7) // 8
    d = bytearray(r.randrange(256) for _ in range(size * 4))
    spare = size * 8 - bits_ * colors * columns_
    if kind == 2:  # fill bits aren't samples
        for i in range(4):
            d[size * (i + 1) - 1] &= 255 << spare & 255
    p = {"Predictor": kind, "Colors": colors, "BitsPerComponent": bits_, "Columns": columns_}
    for f in ("FlateDecode", "LZWDecode"):
        assert chain.decode_chain(chain.encode_chain(bytes(d), [f], [p]), [f], [p]).data == bytes(d)


def test_best_row_filter_is_chosen():
    d = bytes(range(0, 200, 2)) * 3
    assert predictor.png_encode(d, 1, 8, 100)[0] == 1 and predictor.png_encode(d, 1, 8, 100)[101] == 2


def test_chain_stops_at_what_it_cannot_read():
    d = chain.encode_chain(b"jpeg", ["ASCIIHexDecode"])
    x = chain.decode_chain(d, ["ASCIIHexDecode", "DCTDecode"])
    assert (x.data, x.left) == (b"jpeg", ["DCTDecode"]) and "DCT" in x.reason
    assert chain.decode_chain(b"!", ["ASCIIHexDecode"]).left == ["ASCIIHexDecode"]
    assert chain.decode_chain(b"x", ["Crypt"]).data == b"x"


def test_columns(spark):
    filters = ["ASCII85Decode", "FlateDecode", "ASCIIHexDecode"]
    rows = spark.createDataFrame([(b"hello" * 50,), (b"",), (None,)], "d binary")
    out = rows.select("d", columns.decode_stream(columns.encode_stream(F.col("d"), filters), filters).alias("x")).collect()
    assert [r.x.data for r in out] == [r.d for r in out]
    packed = spark.createDataFrame([(bytes([0x7F, 0xFE]),)], "d binary")
    columns.register(spark)
    r = packed.select(F.hex(columns.fax_encode(F.col("d"), 8)).alias("g4"), F.expr("hex(fax_decode(fax_encode(d, 8, 4), 8, 4))").alias("back")).first()
    assert r.g4 == "238D28008008" and r.back == "7FFE"


def test_tiff_predictor_takes_empty_data_and_changes_rows():
    for colors, bits_, width in ((3, 8, 8), (1, 8, 1), (1, 1, 13), (2, 16, 3)):
        assert predictor.tiff(b"", colors, bits_, width, False) == b"" == predictor.tiff(b"", colors, bits_, width, True)
    data = bytes(range(24)) * (predictor.PART // 24 + 2) + b"rest"  # more rows than are taken at once
    coded = predictor.tiff(data, 3, 8, 8, False)
    assert coded[:24] == bytes([0, 1, 2] + [3] * 21) and coded != data and predictor.tiff(coded, 3, 8, 8, True) == data


def test_tiff_query_takes_empty_texts_and_predicts(spark, tmp_path, monkeypatch):
    from vellumspark.plans import QUERIES

    spark.createDataFrame([(1, ""), (2, "abc" * 9), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["codec_predictor_tiff"](spark, str(tmp_path)).collect()}
    assert out[1].back == hashlib.sha256(b"").hexdigest() and out[2].back == hashlib.sha256(b"abc" * 9).hexdigest() and out[1].unread == 0
    from vellumspark.plans import codecs

    used = []
    monkeypatch.setattr(codecs, "_round_trip", lambda t, filters, params: used.extend(params))
    codecs.codec_predictor_tiff(None)
    p = used[0]
    assert predictor.encode(b"abc" * 9, 2, p["Colors"], 8, p["Columns"]) != b"abc" * 9  # the stage has an effect


def test_png_predictor_in_parts():
    data = bytes(i * i % 251 for i in range(predictor.PART + 100))
    for kind in range(10, 16):
        coded = predictor.png_encode(data, 1, 8, 16, kind)
        assert coded[: 17 * 4] == predictor.png_encode(data[:64], 1, 8, 16, kind) and predictor.png_decode(coded, 1, 8, 16) == data
