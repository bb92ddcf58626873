"""Bitmap files: PBM, PGM, PPM."""

from __future__ import annotations

import re

import numpy as np


#: Comments stand between the header's words and end with their line; one white space ends the header, and what follows is data.
_HEAD = re.compile(rb"P([14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


class BitmapError(ValueError):
    """Bytes that aren't a bitmap file."""


def read_pbm(data: bytes) -> np.ndarray:
    """Rows of bits of a plain (P1) or packed (P4) bitmap; 1 is black."""
    m = _HEAD.match(data)
    if not m:
        raise BitmapError("not a bitmap")
    body = data[m.end() :]
    width, height = int(m[2]), int(m[3])
    if m[1] == b"1":
        cells = re.sub(rb"#[^\n]*|[^01]", b"", body)
        if len(cells) < width * height:
            raise BitmapError("too few cells")
        return (np.frombuffer(cells[: width * height], np.uint8) - 48).reshape(height, width)
    size = (width + 7) // 8
    if len(body) < size * height:
        raise BitmapError("too few bytes")
    return np.unpackbits(np.frombuffer(body[: size * height], np.uint8).reshape(height, size), axis=1)[:, :width]


def write_pbm(bits: np.ndarray, plain: bool = False) -> bytes:
    height, width = bits.shape
    head = b"P%d\n%d %d\n" % (1 if plain else 4, width, height)
    if plain:
        return head + b"\n".join(b"".join(b"%d" % x for x in r) for r in bits.tolist()) + b"\n"
    return head + np.packbits(bits.astype(np.uint8), axis=1).tobytes()


def image(samples: bytes, width: int, height: int, components: int, bits: int, inverted: bool = False) -> bytes:
    """A file of decoded image samples: one bit as P4, gray as P5, three components as P6. Four components become three."""
    if bits not in (1, 2, 4, 8, 16):
        raise BitmapError("samples of 1, 2, 4, 8 or 16 bits")
    from vellumspark.codecs.predictor import unpack

    size = (width * components * bits + 7) // 8
    rows = np.frombuffer(samples[: size * height] + bytes(max(0, size * height - len(samples))), np.uint8).reshape(height, size)
    values = unpack(rows, bits, width * components)
    most = (1 << bits) - 1
    values = most - values if inverted else values
    if components == 1 and bits == 1:
        return write_pbm(1 - values)  # 0 is black here, white there
    if components == 4:
        cmyk = values.reshape(height, width, 4)
        values = ((most - cmyk[:, :, 3:]) * (most - cmyk[:, :, :3]) // most).reshape(height, width * 3)
        components = 3
    if components not in (1, 3):
        raise BitmapError("1, 3 or 4 components")
    head = b"P%d\n%d %d\n%d\n" % (5 if components == 1 else 6, width, height, most)
    return head + values.astype(">u2" if bits == 16 else np.uint8).tobytes()


def thumbnail(bits: np.ndarray, rotate: int = 0, most_width: int = 800, most_height: int = 600) -> np.ndarray:
    """Gray values (255 is white) of a turned bitmap, scaled into a box by area means; never enlarged."""
    b = np.rot90(bits, -(rotate // 90) % 4)
    h, w = b.shape
    f = min(1.0, most_width / w, most_height / h)
    nh, nw = max(1, round(h * f)), max(1, round(w * f))
    sums = np.pad(np.cumsum(np.cumsum(b, axis=0, dtype=np.int64), axis=1), ((1, 0), (1, 0)))
    y, x = np.arange(nh + 1) * h // nh, np.arange(nw + 1) * w // nw
    area = np.diff(y)[:, None] * np.diff(x)[None, :]
    dark = sums[y[1:], :][:, x[1:]] - sums[y[:-1], :][:, x[1:]] - sums[y[1:], :][:, x[:-1]] + sums[y[:-1], :][:, x[:-1]]
    return (255 - 255 * dark // area).astype(np.uint8)


def write_pgm(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()
