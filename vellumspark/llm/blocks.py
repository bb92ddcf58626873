"""Packed arrays, ragged gathers and rows of equal key in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def packed(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, compressed: zeros stand together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeezed(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def spread_out(b: bytes) -> bytes:
    """Inverse of squeezed()."""
    return zstandard.ZstdDecompressor().decompress(b)


def rising(a: np.ndarray) -> bytes:
    """packed() of rising numbers of 64 or 32 bits."""
    return packed(np.diff(a, prepend=a.dtype.type(0)))


def risen(b: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(unpacked(b, kind), dtype=kind)


def part_edges(keys: np.ndarray, bits: int) -> list[int]:
    """Where each part of rising keys begins, and the end; a key's first `bits` bits are its part."""
    width = 8 * keys.itemsize
    return np.searchsorted(keys >> keys.dtype.type(width - bits), np.arange((1 << bits) + 1, dtype=keys.dtype)).tolist()


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[i] : starts[i] + lens[i]] for i in `which`, one after another, and their ends."""
    n = lens[which]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    at += np.repeat(starts[which] - ends + n, n)
    return flat[at], ends


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of equal value in a sorted column."""
    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        v = np.asarray(b.column(column))
        edges = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if held and v[s] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(v[s])
            held.append(b.slice(s, e - s))
    if held:
        yield at, pa.Table.from_batches(held)
