"""Data source "page_objects": spark.read.format("page_objects").load(path), one row per object.

Files are listed (by the driver, as data sources are) and read through pyarrow's file systems (local,
HDFS, object stores); a partition takes files up to PARTITION_BYTES together. Filters on obj_num are applied before an object is parsed. Where only Spark can open the
path, use documents.frames.files and .objects.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from vellumspark.documents.file import File, filters_of
from vellumspark.documents.syntax import Stream, kind_of, to_json
from vellumspark.operators.base import release

SCHEMA = "doc_id string, obj_num int, gen int, kind string, value_json string, filters array<string>, raw binary"
ARROW = [("doc_id", pa.string()), ("obj_num", pa.int32()), ("gen", pa.int32()), ("kind", pa.string()), ("value_json", pa.string()), ("filters", pa.list_(pa.string())), ("raw", pa.binary())]
#: Rows, and bytes of streams, that leave at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 1 << 20


#: Bytes of files that a partition takes, each file counting as FILE_BYTES at least.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 256 << 10


@dataclass
class Files(InputPartition):
    paths: list[str]


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.password = options["path"], options.get("password", "").encode()
        self.tests: list = []

    def pushFilters(self, filters):
        kinds = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
        for f in filters:
            if type(f) in kinds and f.attribute == ("obj_num",):
                self.tests.append((kinds[type(f)].__name__, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        store, name = open_path(self.path)
        found = store.get_file_info(name)
        if found.type == fs.FileType.File:
            return [Files([self.path])]
        base = self.path.rstrip("/")
        listed = store.get_file_info(fs.FileSelector(name, recursive=True))
        out, size = [], PARTITION_BYTES
        for x in sorted(listed, key=lambda x: x.path):
            if x.is_file and x.extension == "pdf":
                size += max(x.size, FILE_BYTES)
                if size > PARTITION_BYTES:
                    out.append(Files([]))
                    size = max(x.size, FILE_BYTES)
                out[-1].paths.append(base + x.path[len(name.rstrip("/")) :])
        return out

    def _wanted(self, n: int) -> bool:
        tests = {"EqualTo": lambda v: n == v, "In": lambda v: n in v, "GreaterThan": lambda v: n > v, "GreaterThanOrEqual": lambda v: n >= v, "LessThan": lambda v: n < v, "LessThanOrEqual": lambda v: n <= v}
        return all(tests[kind](v) for _, kind, v in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches of few rows: rows alone would wait in the worker until there are 10,000 of them."""
        arrow, rows, size = pa.schema(ARROW), [], 0
        for path in partition.paths:
            store, name = open_path(path)
            with store.open_input_file(name) as f:
                file = File(f.read(), self.password)
            for ref in file.refs():
                if self._wanted(ref.num):
                    v = file.object(ref)
                    s = isinstance(v, Stream)
                    rows.append((path, ref.num, ref.gen, kind_of(v), json.dumps(to_json(v)), filters_of(v.entries, file.fetch)[0] if s else None, v.raw if s else None))
                    size += len(v.raw) if s else 0
                    if len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, arrow)
        release()


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


class PageObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageObjects)
