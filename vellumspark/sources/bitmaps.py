"""Bitmap files as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellumspark.documents.bitmap import read_pbm


def scanlines(files: DataFrame) -> DataFrame:
    """files: doc_id, content. A row per scanline: doc_id, width, height, row, bits (packed, black is 1)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                bits = read_pbm(content)
                n = len(bits)
                lines = [r.tobytes() for r in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc_id] * n, pa.string()), "width": pa.array([bits.shape[1]] * n, pa.int32()), "height": pa.array([n] * n, pa.int32()), "row": pa.array(range(n), pa.int32()), "bits": pa.array(lines, pa.binary())}
                )

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, width int, height int, row int, bits binary")
