"""ASCII codecs and run-length codes, bytes to bytes."""

from __future__ import annotations

import re

import numpy as np

from vellumspark.functions.text import SPACE

_WHITE = SPACE.encode()
_POWERS = 85 ** np.arange(4, -1, -1)


class CodecError(ValueError):
    """Data that a codec can't read."""


def ahex_decode(data: bytes) -> bytes:
    """Hex digits up to `>`; white space is skipped, an odd last digit is padded with 0."""
    body = data.split(b">", 1)[0].translate(None, _WHITE)
    if not re.fullmatch(rb"[0-9A-Fa-f]*", body):
        raise CodecError("not a hex digit")
    return bytes.fromhex((body + b"0" * (len(body) % 2)).decode())


def ahex_encode(data: bytes, width: int = 70) -> bytes:
    digits = data.hex().encode()
    return b"\n".join(digits[i : i + width] for i in range(0, len(digits), width)) + b">"


def a85_decode(data: bytes) -> bytes:
    """Base-85 groups up to `~>`; `z` stands for four zeros; a partial group of n characters gives n - 1 bytes."""
    body = data.split(b"~", 1)[0].translate(None, _WHITE)
    pieces = body.split(b"z")
    if any(len(x) % 5 for x in pieces[:-1]):
        raise CodecError("z inside a group")
    return bytes(4).join([_groups(x) for x in pieces])


def _groups(body: bytes) -> bytes:
    rest = len(body) % 5
    if rest == 1:
        raise CodecError("a single character at the end")
    digits = np.frombuffer(body + b"u" * (-rest % 5), np.uint8)
    if len(digits) and (digits.min() < 33 or digits.max() > 117):
        raise CodecError("not a base-85 character")
    words = (digits.reshape(-1, 5) - 33).astype(np.int64) @ _POWERS
    if len(words) and words.max() >= 1 << 32:
        raise CodecError("a group is too large")
    return words.astype(">u4").tobytes()[: len(words) * 4 - (-rest % 5)]


def a85_encode(data: bytes, width: int = 70) -> bytes:
    n, rest = len(data) // 4, len(data) % 4
    words = np.frombuffer(data + bytes(-len(data) % 4), ">u4").astype(np.int64)
    digits = (words[:, None] // _POWERS % 85 + 33).astype(np.uint8)
    digits[:n][words[:n] == 0, 0] = 0x7A
    kept = np.ones(digits.shape, bool)
    kept[:n][words[:n] == 0, 1:] = False
    if rest:
        kept[n, rest + 1 :] = False
    out = digits[kept].tobytes()
    return b"\n".join(out[i : i + width] for i in range(0, len(out), width)) + b"~>"


def runlength_decode(data: bytes) -> bytes:
    """0..127: n + 1 bytes follow; 129..255: the next byte 257 - n times; 128 ends."""
    out, at = bytearray(), 0
    while True:
        if at >= len(data):
            raise CodecError("no end mark")
        n = data[at]
        if n == 128:
            return bytes(out)
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            if len(part) != n + 1:
                raise CodecError("a run ends early")
            out += part
            at += n + 2
        else:
            if at + 1 >= len(data):
                raise CodecError("a run lacks its byte")
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2


_RUN = re.compile(rb"(?s)(.)\1{2,127}")


def runlength_encode(data: bytes) -> bytes:
    """Runs of three and more are repeated, the rest goes verbatim."""
    out, at = bytearray(), 0

    def verbatim(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.extend(bytes([len(part[i : i + 128]) - 1]) + part[i : i + 128])

    for m in _RUN.finditer(data):
        verbatim(data[at : m.start()])
        out.extend(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    verbatim(data[at:])
    return bytes(out) + b"\x80"
