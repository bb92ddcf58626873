"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(lists: list[list[str]]) -> np.ndarray:
    """64-bit hashes of all words of the lists, one after another; each distinct word is hashed once."""
    flat = pa.array([w for ws in lists for w in ws], pa.large_string()).dictionary_encode()
    if not len(flat):
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    return hashes[np.asarray(flat.indices)]
