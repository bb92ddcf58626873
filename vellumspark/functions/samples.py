"""Sample and bit arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp_byte(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(255))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """struct(r, g, b): (255 - k) * (255 - ink) / 255, whole numbers."""
    one = lambda x: F.floor((255 - k) * (255 - x) / 255).cast("int")
    return F.struct(one(c).alias("r"), one(m).alias("g"), one(y).alias("b"))


def interpolate(value: Column, most: Column | int, low: Column | float, high: Column | float) -> Column:
    """A sample of 0..most on the line from low to high, clamped to 0..most first."""
    most = F.lit(most) if isinstance(most, int) else most
    v = F.least(F.greatest(value, F.lit(0)), most)
    low, high = (F.lit(float(x)) if not isinstance(x, Column) else x for x in (low, high))
    return low + v * (high - low) / most


def quantize(value: Column, most: Column | int, low: Column | float, high: Column | float) -> Column:
    """Inverse of interpolate: rounded half up and clamped to 0..most."""
    most = F.lit(most) if isinstance(most, int) else most
    low, high = (F.lit(float(x)) if not isinstance(x, Column) else x for x in (low, high))
    return F.least(F.greatest(F.floor(F.lit(0.5) + (value - low) * most / (high - low)), F.lit(0)), most).cast("int")


#: Samples that are worked on at once.
AT_ONCE = 1 << 18


def _slices(counts: np.ndarray) -> Iterator[slice]:
    """Rows that have AT_ONCE samples together, or one row."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield slice(at, stop)
        at = stop


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each sample its row and its place there."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - _starts(counts)[rows]


def _unpacked(c: pa.Array, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples, and which of them lie behind their row's bytes."""
    held = np.frombuffer(c.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    ends = np.where(np.asarray(c.is_valid()), offsets[1:], offsets[:-1])
    rows, k = _places(counts)
    at = offsets[rows] + k * bits // 8
    gone = at + max(1, bits // 8) > ends[rows]
    at[gone] = 0
    if not len(held):
        return np.zeros(len(rows), np.int32), gone
    if bits == 16:
        at[gone] = -1
        return held[at].astype(np.int32) * 256 + held[at + 1 - gone], gone
    return ((held[at] >> (8 - bits - k * bits % 8).astype(np.uint8)) & ((1 << bits) - 1)).astype(np.int32), gone


def _unpacker(bits: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def unpack(c: pa.Array, count: pa.Array) -> pa.Array:
        c, counts = c.cast(pa.binary()), np.maximum(count.fill_null(0).to_numpy(zero_copy_only=False), 0)
        parts = [pa.array(v, pa.int32(), mask=gone) for x in _slices(counts) for v, gone in [_unpacked(c[x], counts[x], bits)]]
        return pa.ListArray.from_arrays(pa.array(_starts(counts), pa.int32()), pa.concat_arrays([pa.array([], pa.int32()), *parts]))

    return unpack


def _packed(values: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """The bytes of all rows, and how many each has."""
    if bits == 16:
        return values.astype(">u2").tobytes(), counts * 2
    per = 8 // bits
    sizes = -(-counts // per)
    rows, k = _places(counts)
    cells = np.zeros(int(sizes.sum()) * per, np.uint8)
    cells[_starts(sizes)[rows] * per + k] = values
    return (cells.reshape(-1, per) @ (1 << bits * np.arange(per)[::-1]).astype(np.uint8)).astype(np.uint8).tobytes(), sizes


def _packer(bits: int):
    @F.arrow_udf(T.BinaryType())
    def pack(samples: pa.Array) -> pa.Array:
        data, sizes = [], [np.zeros(0, np.int64)]
        for x in _slices(np.asarray(pc.list_value_length(samples).fill_null(0))):
            part = samples[x]
            values, rows = part.flatten(), np.asarray(pc.list_parent_indices(part))
            known = np.asarray(values.is_valid())  # samples that are null are left out
            out, n = _packed(values.drop_null().to_numpy(zero_copy_only=False), np.bincount(rows[known], minlength=len(part)), bits)
            data.append(out)
            sizes.append(n)
        offsets = _starts(np.concatenate(sizes)).astype(np.int32)
        valid = np.packbits(np.asarray(samples.is_valid()), bitorder="little").tobytes()
        return pa.Array.from_buffers(pa.binary(), len(samples), [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])

    return pack


_UNPACK, _PACK = ({bits: f(bits) for bits in (1, 2, 4, 8, 16)} for f in (_unpacker, _packer))


def unpack_bits(c: Column, bits: int, count: Column | int) -> Column:
    """Packed samples of 1, 2, 4, 8 or 16 bits, most significant first, as an array of int; null behind the end. Whole Arrow batches at once."""
    return _UNPACK[bits](c, (F.lit(count) if isinstance(count, int) else count).cast("int"))


def pack_bits(samples: Column, bits: int) -> Column:
    """Inverse of unpack_bits; the last byte is filled with zeros. The array's samples are 0..2^bits - 1."""
    return _PACK[bits](samples.cast("array<int>"))


def decode_samples(samples: Column, bits: int, ranges: list[tuple[float, float]]) -> Column:
    """Samples to doubles; component i % len(ranges) has the range of that place."""
    lows, highs = (F.array(*[F.lit(float(x)) for x in r]) for r in zip(*ranges, strict=True))
    n, most = len(ranges), (1 << bits) - 1
    return F.transform(samples, lambda x, i: F.get(lows, i % n) + x * (F.get(highs, i % n) - F.get(lows, i % n)) / most)


def encode_samples(values: Column, bits: int, ranges: list[tuple[float, float]]) -> Column:
    """Inverse of decode_samples, rounded half up and clamped."""
    lows, highs = (F.array(*[F.lit(float(x)) for x in r]) for r in zip(*ranges, strict=True))
    n, most = len(ranges), (1 << bits) - 1
    return F.transform(values, lambda x, i: quantize(x, most, F.get(lows, i % n), F.get(highs, i % n)))


def invert_bits(row: Column, width: Column | int) -> Column:
    """Complements a packed 1-bit row of `width` pixels; padding stays clear."""
    width = F.lit(width) if isinstance(width, int) else width
    return pack_bits(F.transform(unpack_bits(row, 1, width), lambda x: 1 - x), 1)


def change_positions(bits: Column) -> Column:
    """Places where an array of bits changes colour, white (0) first; the width ends the list."""
    n = F.size(bits)
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(bits, i) != F.coalesce(F.get(bits, i - 1), F.lit(0)))
    return F.when(n > 0, F.concat(at, F.array(n))).otherwise(F.array(F.lit(0)))


def run_lengths(changes: Column) -> Column:
    """Gaps between change positions, the first from 0."""
    return F.transform(changes, lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(changes, i - 1)))


def bits_of_changes(changes: Column) -> Column:
    """Inverse of change_positions: an array of bits. Run i has colour i mod 2, so the runs are written one after another."""
    return F.flatten(F.transform(run_lengths(changes), lambda n, i: F.array_repeat((i % 2).cast("int"), n)))


def fit_scale(width: Column, height: Column, most_width: int = 800, most_height: int = 600) -> Column:
    """Factor that fits an image into a box and keeps its aspect."""
    return F.least(F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
