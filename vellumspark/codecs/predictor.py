"""Predictors 2 (differences within a row) and 10 to 15 (a filter per row)."""

from __future__ import annotations

import numpy as np

from vellumspark.codecs.text import CodecError


#: Bytes that are worked on at once.
PART = 1 << 16


def unpack(rows: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Rows of bytes to rows of n samples."""
    if bits == 8:
        return rows[:, :n].astype(np.int64)
    if bits == 16:
        return rows.reshape(len(rows), -1).view(">u2")[:, :n].astype(np.int64)
    each = np.unpackbits(rows, axis=1)[:, : n * bits].reshape(len(rows), n, bits)
    return each @ (1 << np.arange(bits)[::-1]).astype(np.int64)


def pack(samples: np.ndarray, bits: int) -> np.ndarray:
    if bits == 8:
        return samples.astype(np.uint8)
    if bits == 16:
        return np.ascontiguousarray(samples.astype(">u2")).view(np.uint8).reshape(len(samples), -1)
    each = (samples[:, :, None] >> np.arange(bits)[::-1]) & 1
    return np.packbits(each.reshape(len(samples), -1).astype(np.uint8), axis=1)


def _rows(data: bytes, size: int) -> np.ndarray:
    """The data in rows of `size` bytes, the last one filled with zeros."""
    return np.frombuffer(data + bytes(-len(data) % size), np.uint8).reshape(-1, size)


def tiff(data: bytes, colors: int, bits: int, columns: int, decode: bool) -> bytes:
    """Rows are taken PART bytes at a time, so that the samples' whole numbers stay small beside the data."""
    size = (colors * bits * columns + 7) // 8
    step = max(1, PART // size) * size
    return b"".join([_differences(data[i : i + step], size, colors, bits, columns, decode) for i in range(0, len(data), step)])


def _differences(data: bytes, size: int, colors: int, bits: int, columns: int, decode: bool) -> bytes:
    s = unpack(_rows(data, size), bits, colors * columns).reshape(-1, columns, colors)
    if decode:
        s = np.cumsum(s, axis=1)
    else:
        s[:, 1:] = s[:, 1:] - s[:, :-1]
    return pack((s % (1 << bits)).reshape(len(s), -1), bits).tobytes()[: len(data)]


def _paeth(a: np.ndarray | int, b: np.ndarray | int, c: np.ndarray | int):
    p = a + b - c
    x, y, z = abs(p - a), abs(p - b), abs(p - c)
    return np.where((x <= y) & (x <= z), a, np.where(y <= z, b, c))


def png_encode(data: bytes, colors: int, bits: int, columns: int, kind: int = 15) -> bytes:
    """kind 10..14: that filter in every row; 15: the one of the least sum of absolute residues, the first on ties. Rows are taken PART bytes at a time."""
    size, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    take, out, up = max(1, PART // size) * size, [], np.zeros((1, size), np.int16)
    for at in range(0, len(data), take):
        rows = _rows(data[at : at + take], size).astype(np.int16)
        out.append(_filtered(rows, np.vstack([up, rows[:-1]]), step, kind))
        up = rows[-1:]
    left = -len(data) % size
    return b"".join(out)[: -left or None]


def _filtered(rows: np.ndarray, up: np.ndarray, step: int, kind: int) -> bytes:
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], corner[:, step:] = rows[:, :-step], up[:, :-step]
    each = np.stack([rows, rows - left, rows - up, rows - (left + up) // 2, rows - _paeth(left, up, corner)]) & 255
    if kind == 15:
        best = np.minimum(each, 256 - each).sum(axis=2, dtype=np.int64).argmin(axis=0)
    else:
        best = np.full(len(rows), kind - 10)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best, each[best, np.arange(len(rows))]
    return lines.tobytes()


def png_decode(data: bytes, colors: int, bits: int, columns: int) -> bytes:
    size, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    up, out = bytes(size), []
    for at in range(0, len(data), size + 1):
        kind, raw = data[at], data[at + 1 : at + 1 + size]
        row = bytearray(raw.ljust(size, b"\0"))
        if kind == 1:
            for i in range(step, size):
                row[i] = (row[i] + row[i - step]) & 255
        elif kind == 2:
            row = bytearray([(x + b) & 255 for x, b in zip(row, up, strict=True)])
        elif kind == 3:
            for i, b in enumerate(up):
                row[i] = (row[i] + (((row[i - step] if i >= step else 0) + b) >> 1)) & 255
        elif kind == 4:
            for i, b in enumerate(up):
                a, c = (row[i - step], up[i - step]) if i >= step else (0, 0)
                x, y, z = abs(b - c), abs(a - c), abs(a + b - c - c)
                row[i] = (row[i] + (a if x <= y and x <= z else b if y <= z else c)) & 255
        elif kind:
            raise CodecError("an unknown row filter")
        up = bytes(row)
        out.append(up[: len(raw)])
    return b"".join(out)


def decode(data: bytes, predictor: int = 1, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    if predictor < 2:
        return data
    return tiff(data, colors, bits, columns, True) if predictor == 2 else png_decode(data, colors, bits, columns)


def encode(data: bytes, predictor: int = 1, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    if predictor < 2:
        return data
    return tiff(data, colors, bits, columns, False) if predictor == 2 else png_encode(data, colors, bits, columns, predictor)
