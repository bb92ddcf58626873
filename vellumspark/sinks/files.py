"""Whole files written to a folder, one per row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumspark.sources.data_source import open_path


def write_files(rows: DataFrame, folder: str, extension: str = "pdf") -> DataFrame:
    """rows: doc_id, content. Writes each content to `folder` and returns doc_id, path, bytes when an action runs.

    A file is written under another name and moved into place, so a task that runs again leaves whole
    files only. Names come from the doc_id: what isn't a letter, digit, point or dash becomes _.
    Rows of null content are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = open_path(folder)
        store.create_dir(base)
        for b in batches:
            out = []
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                if content is None:
                    continue
                stem = "".join(c if c.isalnum() or c in ".-" else "_" for c in doc_id.rsplit("/", 1)[-1].removesuffix(f".{extension}"))
                name, part = f"{stem}.{extension}", f".{uuid.uuid4().hex}.part"
                with store.open_output_stream(f"{base}/{part}") as f:
                    f.write(content)
                store.move(f"{base}/{part}", f"{base}/{name}")
                out.append((doc_id, f"{folder.rstrip('/')}/{name}", len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["doc_id", "path", "bytes"])

    return rows.select("doc_id", "content").mapInArrow(run, "doc_id string, path string, bytes long")
