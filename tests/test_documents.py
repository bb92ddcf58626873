import hashlib

import numpy as np
import pytest

from vellumspark.codecs import fax
from vellumspark.crypto import ciphers, security
from vellumspark.documents import bitmap, syntax
from vellumspark.documents.file import File, FileError
from vellumspark.documents.syntax import Name, Ref, Stream
from vellumspark.documents.write import Writer, merge, select_pages, stream


def sample(pages=3, **encryption):
    """Pages that share a font, with contents in several codings, an annotation cycle and an image."""
    w = Writer()
    font = w.add({"Type": Name("Font"), "BaseFont": Name("A b#c")})
    w.info = w.add({"Title": b"A (title) \\ \r\0", "Raw": bytes(range(256))})
    chains = [["FlateDecode"], ["ASCII85Decode", "LZWDecode"], ["ASCIIHexDecode", "RunLengthDecode"], []]
    for i in range(pages):
        bits = (np.arange(16 * 4).reshape(4, 16) * (i + 3) % 5 == 0).astype(np.uint8)
        image = w.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 16, "Height": 4, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 16}}, fax.encode(1 - bits, -1)))
        body = w.add(stream(b"BT (page %d) Tj ET" % (i + 1), chains[i % 4]))
        note = w.reserve()
        page = w.page([0, 0, 612.5, 792], [body], {"Font": {"F1": font}, "XObject": {"Im1": image}}, rotate=90 * (i % 4), Annots=[note])
        w.put(note, {"Type": Name("Annot"), "P": page, "N": w.add(i)})
    return w.bytes(**encryption)


def texts(data, password=b""):
    f = File(data, password, strict=True)
    return [f.decode(f.fetch(p.entries["Contents"])).data for p in f.pages()]


def test_objects_round_trip():
    values = [None, True, -5, 0.5, -0.25, Name("a b/c#"), b"(x\\)\r\n\0", bytes(range(256)), [1, [Name("x")], {}], {"K": Ref(3, 1), "L": [None, 2]}]
    for v in values:
        assert syntax.parse(syntax.write(v)) == v
        assert syntax.from_json(syntax.to_json(v)) == v
    assert syntax.parse(b"<< /A 1 /A 2 /B null /C (a\\\r\nb\\053(c)) >> %x") == {"A": 2, "C": b"ab+(c)"}
    assert syntax.parse(b"[.5 -.5 +1 4. 1 0 R 1 0 <4 1 4>]") == [0.5, -0.5, 1, 4.0, Ref(1, 0), 1, 0, b"A@"]
    for bad in (b"<<", b"(", b"99999999999", b"<4x>", b"foo", b"1 2"):
        with pytest.raises(syntax.SyntaxError_):
            syntax.parse(bad)


def test_write_and_read():
    d = sample()
    f = File(d, strict=True)
    assert [p.inherited["Rotate"] if "Rotate" in p.inherited else 0 for p in f.pages()] == [0, 90, 180]
    assert texts(d) == [b"BT (page 1) Tj ET", b"BT (page 2) Tj ET", b"BT (page 3) Tj ET"]
    assert f.fetch(f.trailer["Info"]) == {"Title": b"A (title) \\ \r\0", "Raw": bytes(range(256))}


def test_select_and_merge():
    d = sample(4)
    s = select_pages(d, 2, 2)
    assert texts(s) == [b"BT (page 2) Tj ET", b"BT (page 3) Tj ET"]
    f = File(s)
    fonts = {f.fetch(p.inherited["Resources"])["Font"]["F1"] for p in f.pages()}
    assert len(fonts) == 1  # shared by both pages
    note = f.fetch(f.pages()[0].entries["Annots"][0])
    assert note["P"] == f.pages()[0].ref and note["N"] == 1  # the cycle stays inside; a referenced number became a value
    assert texts(merge([s, d])) == [b"BT (page %d) Tj ET" % i for i in (2, 3, 1, 2, 3, 4)]
    with pytest.raises(IndexError):
        select_pages(d, 4, 2)


@pytest.mark.parametrize("revision,aes", [(2, False), (3, False), (4, False), (4, True), (5, True)])
def test_encryption(revision, aes):
    d = sample(2, user=b"", owner=b"boss", revision=revision, aes=aes)
    assert b"BT (page" not in d and texts(d) == [b"BT (page 1) Tj ET", b"BT (page 2) Tj ET"]
    assert File(d).fetch(File(d).trailer["Info"])["Title"] == b"A (title) \\ \r\0"
    assert texts(d, b"boss")
    e = sample(1, user=b"u", owner=b"o", revision=revision, aes=aes)
    assert texts(e, b"u") and texts(e, b"o")
    with pytest.raises(security.SecurityError):
        File(e, b"wrong")


def test_ciphers_match_published_vectors():
    assert ciphers.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key = bytes(range(16))
    assert ciphers.Aes(key).block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert ciphers.Aes(bytes(range(32))).block(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for n in (0, 1, 15, 16, 17):
        assert ciphers.aes_decrypt(key, ciphers.aes_encrypt(key, b"x" * n)) == b"x" * n


def with_xref_stream(d):
    """The file's objects again, small ones inside an object stream, behind a cross-reference stream; the old table is its predecessor."""
    f = File(d)
    inside = [r for r in f.refs() if not isinstance(f.object(r), Stream)]
    bodies = [syntax.write(f.object(r)) for r in inside]
    starts, at = [], 0
    for b in bodies:
        starts.append(at)
        at += len(b) + 1
    head = b" ".join(b"%d %d" % (r.num, s) for r, s in zip(inside, starts, strict=True)) + b" "
    n = f.trailer["Size"]
    out = bytearray(d)
    where = len(out)
    out += b"%d 0 obj\n" % n + syntax.write(stream(head + b" ".join(bodies), ["FlateDecode"], Type=Name("ObjStm"), N=len(inside), First=len(head))) + b"\nendobj\n"
    at = len(out)
    kinds = {r.num: (2, n, i) for i, r in enumerate(inside)} | {n: (1, where, 0), n + 1: (1, at, 0)}
    rows = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for _, (a, b, c) in sorted(kinds.items()))
    index = [x for k in sorted(kinds) for x in (k, 1)]
    p = {"Predictor": 12, "Columns": 7}
    x = stream(rows, ["FlateDecode"], [p], Type=Name("XRef"), W=[1, 4, 2], Index=index, Size=n + 2, Root=f.trailer["Root"], Info=f.trailer["Info"], Prev=f.start)
    out += b"%d 0 obj\n" % (n + 1) + syntax.write(x) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def test_xref_streams_and_object_streams():
    d = with_xref_stream(sample())
    f = File(d, strict=True)
    assert texts(d) == texts(sample()) and {e.type for e in f.entries.values()} == {"n", "c", "f"}
    assert len({e.section for e in f.sections}) == 2
    assert f.object(Ref(999, 0)) is None


def test_broken_files():
    d = sample()
    for bad in (b"", b"%PDF-1.4", d[: len(d) // 2], d.replace(b"startxref", b"startxxxx")):
        with pytest.raises(FileError):
            File(bad)
    f = File(d.replace(b"/Count 3", b"/Count 4"))
    f.pages()
    assert any("Count" in p for p in f.problems)
    with pytest.raises(FileError):
        File(d.replace(b"/Count 3", b"/Count 4"), strict=True).pages()


def test_bitmaps():
    bits = (np.arange(60).reshape(5, 12) % 7 == 0).astype(np.uint8)
    for plain in (True, False):
        assert (bitmap.read_pbm(bitmap.write_pbm(bits, plain)) == bits).all()
    assert (bitmap.read_pbm(b"P1\n# note\n3 2\n1 0 1\n010\n") == [[1, 0, 1], [0, 1, 0]]).all()
    assert bitmap.image(bytes([0, 128, 255]), 3, 1, 1, 8) == b"P5\n3 1\n255\n\0\x80\xff"
    assert bitmap.image(bytes([0, 255, 0, 0]), 1, 1, 4, 8) == b"P6\n1 1\n255\n\xff\0\xff"
    t = bitmap.thumbnail(np.ones((2400, 1600), np.uint8), 90)
    assert t.shape == (533, 800) and (t == 0).all()


def test_fixed_ids():
    assert sample() == sample() and hashlib.md5(sample()).digest()


def test_older_sections_hold_only_by_generation():
    """A trailer entry that the newest section dropped stays dropped; an object's newest entry wins unless an older one has a higher generation."""
    from vellumspark.documents.file import Entry, _beats

    new, old = Entry(3, "n", 900, 0, 0), Entry(3, "n", 100, 0, 1)
    assert not _beats(old, new) and _beats(old._replace(gen=2), new)
    assert not _beats(old._replace(gen=2), new._replace(type="c")) and not _beats(old._replace(type="c", gen=5), new)
    d = sample()
    f = File(d)
    bare = {"Size": f.trailer["Size"], "Root": f.trailer["Root"], "Prev": f.start}
    more = d + b"xref\n0 0\ntrailer\n" + syntax.write(bare) + b"\nstartxref\n%d\n%%%%EOF\n" % len(d)
    assert "Info" in f.trailer and "Info" not in File(more).trailer and texts(more) == texts(d)


def test_page_edits():
    w = Writer()
    page = w.page([0, 0, 10, 10], [], {})
    w.set_rotation(page, 90)
    w.set_box(page, [0, 0, 5, 5], "CropBox")
    for i in range(2):
        w.add_content(page, w.add(stream(b"%d" % i)))
    w.add_resource(page, "Font", Ref(9, 0), "F1")
    w.add_resource(page, "ProcSet", "PDF")
    p = File(w.bytes(), strict=True).pages()[0]
    assert p.inherited["Rotate"] == 90 and p.inherited["CropBox"] == [0, 0, 5, 5] and len(p.entries["Contents"]) == 2
    assert p.entries["Resources"] == {"Font": {"F1": Ref(9, 0)}, "ProcSet": [Name("PDF")]}
    with pytest.raises(ValueError):
        w.set_rotation(page, 45)


def test_registered_ciphers_and_spaces():
    from vellumspark.functions import colour

    flip = security.Cipher(lambda h, d, n, g: d[::-1], lambda h, d, n, g, iv: d[::-1])
    security.register_cipher("Flip", flip)
    h = security.Handler(b"k", {"stream": "Flip"})
    assert h.open(h.seal(b"abc", 1, 0), 1, 0) == b"abc" and h.seal(b"abc", 1, 0) == b"cba" and h.seal(b"abc", 1, 0, "string") == b"abc"
    del security.CIPHERS["Flip"]
    colour.register_space("DeviceN6", 6)
    assert colour.ADDED.pop("DeviceN6") == 6
    with pytest.raises(ValueError):
        colour.register_space("DeviceRGB", 4)


def test_bitmap_data_that_looks_like_a_comment():
    raw = b"#a\nb" + bytes([10, 35, 1, 10, 35, 10])
    for head in (b"P4\n40 2\n", b"P4\n# note\n40 # more\n2 "):
        assert bitmap.read_pbm(head + raw).shape == (2, 40) and np.packbits(bitmap.read_pbm(head + raw), axis=1).tobytes() == raw
    assert (bitmap.read_pbm(b"P1 # 9\n3 2\n1 0 1\n# 1 1\n010\n") == [[1, 0, 1], [0, 1, 0]]).all()


def test_bitmap_query_of_bits_that_look_like_a_comment(spark, tmp_path):
    from vellumspark.plans import QUERIES

    bits = f"{ord('#'):08b}{ord('a'):08b}{ord(chr(10)):08b}"
    spark.createDataFrame([(i, 7, "click" if b == "1" else "view") for i, b in enumerate(bits)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["bitmap_files"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.width, r.row, r.bits) for r in rows) == [(f"{k}-7", 24, i, "23610a") for k in ("P1", "P4") for i in (0, 1)]


def test_password_steps_that_files_share_are_taken_once():
    from vellumspark.crypto import security

    security.user_of_owner.cache_clear()
    files = [sample(1, user=b"u", owner=b"o", revision=3, aes=False) for _ in range(3)]
    assert all(File(f, b"o").pages() for f in files)
    assert security.user_of_owner.cache_info().hits >= 2
