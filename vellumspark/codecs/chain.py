"""Registry of stream codecs, and chains of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from vellumspark.codecs import fax, lzw, predictor, text
from vellumspark.codecs.text import CodecError


@dataclass
class Decoded:
    """What a chain gives. left: filters that weren't applied, from the first that no codec here reads."""

    data: bytes
    left: list[str]
    reason: str | None = None


def _predict(f: Callable, data: bytes, p: dict) -> bytes:
    return f(data, int(p.get("Predictor", 1)), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8)), int(p.get("Columns", 1)))


def flate_decode(data: bytes, p: dict) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error as e:
        raise CodecError(str(e)) from e
    return _predict(predictor.decode, out, p)


def flate_encode(data: bytes, p: dict) -> bytes:
    return zlib.compress(_predict(predictor.encode, data, p), 9)


def lzw_decode(data: bytes, p: dict) -> bytes:
    return _predict(predictor.decode, lzw.decode(data, int(p.get("EarlyChange", 1))), p)


def lzw_encode(data: bytes, p: dict) -> bytes:
    return lzw.encode(_predict(predictor.encode, data, p), int(p.get("EarlyChange", 1)))


def _fax_shape(p: dict) -> tuple[int, int, int, bool]:
    if p.get("EncodedByteAlign") or p.get("EndOfLine"):
        raise CodecError("byte-aligned lines and end-of-line marks aren't supported")
    return int(p.get("Columns", fax.WIDTH)), int(p.get("K", 0)), int(p.get("Rows", 0)), bool(p.get("BlackIs1", False))


def fax_decode(data: bytes, p: dict) -> bytes:
    """Packed rows; black is 0 unless BlackIs1."""
    width, k, rows, black = _fax_shape(p)
    bits = fax.decode(data, width, k, rows)
    return np.packbits(bits if black else 1 - bits, axis=1).tobytes()


def fax_encode(data: bytes, p: dict) -> bytes:
    width, k, _, black = _fax_shape(p)
    size = (width + 7) // 8
    if len(data) % size:
        raise CodecError("not whole rows")
    bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, size), axis=1)[:, :width]
    return fax.encode(bits if black else 1 - bits, k)


DECODERS: dict[str, Callable[[bytes, dict], bytes]] = {
    "ASCIIHexDecode": lambda d, p: text.ahex_decode(d),
    "ASCII85Decode": lambda d, p: text.a85_decode(d),
    "RunLengthDecode": lambda d, p: text.runlength_decode(d),
    "LZWDecode": lzw_decode,
    "FlateDecode": flate_decode,
    "CCITTFaxDecode": fax_decode,
}
ENCODERS: dict[str, Callable[[bytes, dict], bytes]] = {
    "ASCIIHexDecode": lambda d, p: text.ahex_encode(d),
    "ASCII85Decode": lambda d, p: text.a85_encode(d),
    "RunLengthDecode": lambda d, p: text.runlength_encode(d),
    "LZWDecode": lzw_encode,
    "FlateDecode": flate_encode,
    "CCITTFaxDecode": fax_encode,
}
#: Short names that inline images use (fixed values).
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "LZW": "LZWDecode", "Fl": "FlateDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}


def register(name: str, decode: Callable[[bytes, dict], bytes], encode: Callable[[bytes, dict], bytes] | None = None) -> None:
    """Adds or replaces a codec."""
    DECODERS[name] = decode
    if encode:
        ENCODERS[name] = encode


def decode_chain(data: bytes, filters: list[str], params: list[dict | None] | None = None) -> Decoded:
    """Applies filters in order. A chain with a filter that nothing here reads (JPEG, JBIG2, JPX or an unknown one) stops there."""
    params = [p or {} for p in (params or [])]
    params += [{}] * (len(filters) - len(params))
    for i, (f, p) in enumerate(zip(filters, params, strict=False)):
        f = SHORT.get(f, f)
        if f == "Crypt":
            if i or p.get("Name", "Identity") != "Identity":
                return Decoded(data, filters[i:], "crypt filter")
            continue
        if f not in DECODERS:
            return Decoded(data, filters[i:], f"unsupported {f}")
        try:
            data = DECODERS[f](data, p)
        except CodecError as e:
            return Decoded(data, filters[i:], str(e))
    return Decoded(data, [])


def encode_chain(data: bytes, filters: list[str], params: list[dict | None] | None = None) -> bytes:
    """Bytes that decode_chain reads back: the last filter is applied first."""
    params = [p or {} for p in (params or [])]
    params += [{}] * (len(filters) - len(params))
    for f, p in reversed(list(zip(filters, params, strict=False))):
        f = SHORT.get(f, f)
        if f not in ENCODERS:
            raise CodecError(f"no encoder for {f}")
        data = ENCODERS[f](data, p)
    return data
