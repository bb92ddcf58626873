"""Token-id files in patched frame-of-reference blocks.

A file: magic, blocks, doc table, block index, trailer. A block holds up to BLOCK ids: least id
(u32), count (u16), width (u8), exceptions (u16), then count values of `width` bits (whole low bytes
first, the rest as bit planes), then the exceptions' places (u16) and high parts (u32). The width is
the bit length of the PERCENTILE-th difference from the least id, so a few outliers don't widen the
others. The doc table has ids, null flags and lengths; the index has each block's first byte.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import fresh_path, open_store, release, slices, small_batches, stored, whole_uri
from vellumspark.llm.vocab import library_units

MAGIC = b"VPFOR\x00\x00\x01"
BLOCK = 1024
PERCENTILE = 90
HEAD = struct.Struct("<IHBH")
TRAILER = struct.Struct("<QQQQ8s")  # ids, docs, start of the doc table, start of the block index


def _pack(d: np.ndarray, width: int) -> list[bytes]:
    """Rows of d, each value's low `width` bits."""
    parts = []
    for j in range(0, width - width % 8, 8):
        parts.append((d >> j).astype(np.uint8))
    for j in range(width - width % 8, width):
        parts.append(np.packbits(((d >> j) & 1).astype(np.uint8), axis=1))
    return [b"".join(x) for x in zip(*([r.tobytes() for r in p] for p in parts), strict=True)] if parts else [b""] * len(d)


def _unpack(rows: np.ndarray, n: int, width: int) -> np.ndarray:
    """Inverse of _pack: rows of bytes to rows of n values."""
    out, at = np.zeros((len(rows), n), np.uint32), 0
    for j in range(0, width - width % 8, 8):
        out |= rows[:, at : at + n].astype(np.uint32) << np.uint32(j)
        at += n
    step = (n + 7) // 8
    for j in range(width - width % 8, width):
        out |= np.unpackbits(rows[:, at : at + step], axis=1, count=n).astype(np.uint32) << np.uint32(j)
        at += step
    return out


def _packed_len(n: int, width: int) -> int:
    return n * (width // 8) + (n + 7) // 8 * (width % 8)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of BLOCK ids each, the last maybe shorter."""
    out: list[bytes] = []
    full = len(ids) // BLOCK * BLOCK
    step = 256 * BLOCK  # so many blocks at once
    for part, n in (*((ids[i : min(full, i + step)], BLOCK) for i in range(0, full, step)), (ids[full:], len(ids) - full)):
        if not len(part):
            continue
        d = part.reshape(-1, n).astype(np.uint32)
        least = d.min(axis=1)
        d -= least[:, None]
        k = min(n - 1, n * percentile // 100)
        at = np.partition(d, k, axis=1)[:, k]
        widths = np.array([int(x).bit_length() for x in at])
        blocks: list[bytes] = [b""] * len(d)
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            own = d[rows]
            high = own >> np.uint32(w) if w < 32 else np.zeros_like(own)
            for i, row, body, h in zip(rows.tolist(), rows, _pack(own, w), high, strict=True):
                odd = np.flatnonzero(h)
                blocks[i] = HEAD.pack(int(least[row]), n, w, len(odd)) + body + odd.astype("<u2").tobytes() + h[odd].astype("<u4").tobytes()
        out += blocks
    return out


def decode_blocks(data: memoryview, starts: list[int]) -> np.ndarray:
    """Ids of blocks that follow one another; those of one size and width are unpacked together."""
    heads = [HEAD.unpack_from(data, at) for at in starts]
    places = np.cumsum([0, *(h[1] for h in heads)])
    out = np.empty(places[-1], np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, w, _) in enumerate(heads):
        alike.setdefault((n, w), []).append(k)
    for (n, w), ks in alike.items():
        size = _packed_len(n, w)
        rows = np.frombuffer(b"".join([data[starts[k] + HEAD.size : starts[k] + HEAD.size + size] for k in ks]), np.uint8).reshape(len(ks), size)
        for k, d in zip(ks, _unpack(rows, n, w), strict=True):
            least, _, _, odd = heads[k]
            if odd:
                at = starts[k] + HEAD.size + size
                d[np.frombuffer(data, "<u2", odd, at)] |= (np.frombuffer(data, "<u4", odd, at + 2 * odd).astype(np.uint64) << np.uint64(w)).astype(np.uint32)
            out[places[k] : places[k + 1]] = d + np.uint32(least)
    return out


def file_bytes(docs: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    starts = np.cumsum([len(MAGIC), *map(len, blocks)], dtype=np.uint64)
    table = np.array([x or 0 for x in docs], "<i8").tobytes() + np.array([x is None for x in docs], np.uint8).tobytes() + counts.astype("<u8").tobytes()
    body = b"".join([MAGIC, *blocks])
    return body + table + starts[:-1].astype("<u8").tobytes() + TRAILER.pack(len(ids), len(docs), len(body), len(body) + len(table), MAGIC)


class TokenFile:
    """Random access to one file: docs, counts, ids(from, to)."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.n, docs, table, index, magic = TRAILER.unpack(self.data[-TRAILER.size :])
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        null = np.frombuffer(data, np.uint8, docs, table + 8 * docs)
        self.docs = [None if z else x for x, z in zip(np.frombuffer(data, "<i8", docs, table).tolist(), null.tolist(), strict=True)]
        self.counts = np.frombuffer(data, "<u8", docs, table + 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", -(-self.n // BLOCK), index).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from a place on; only the blocks that hold them are unpacked."""
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        return decode_blocks(self.data, self.starts[first : last + 1])[start - first * BLOCK : stop - first * BLOCK]


def write(docs: DataFrame, folder: str, tokenizer: str, words: bool, end: int | None = None, file_ids: int = 1 << 20) -> DataFrame:
    """Encodes the whole texts and writes token files under `folder`, ascending by doc_id across and within files.

    docs: doc_id (long), text; other columns are ignored. A null doc_id comes first, a null text is
    empty, rows with one doc_id are ordered by a hash of their text, and an empty table gives no files. `end` is appended to each
    document. Returns the files that count, stored: path, part, seq, n_docs, n_ids. The texts are
    dealt out by range of (doc_id, hash), so no doc_id is too large for a task. A task that runs
    again writes files of other names, and only those in the result count. file_ids: ids after
    which a file ends; one document stays in one file.
    """
    folder = whole_uri(folder)
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # rows equal in doc_id and text may be dealt out anyhow, so a number of their own lets ranges part them
    rows = rows.repartitionByRange(F.col("doc_id"), F.col("h"), F.rand(3)).sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]):
        units, part, seq = library_units(tokenizer, words), TaskContext.get().partitionId(), 0
        store, base = open_store(folder)
        store.create_dir(base)
        ids: list[bytes] = []
        own: list[int | None] = []
        held = 0

        def flush():
            nonlocal ids, own, held, seq
            path = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.vpfor"
            counts = np.array([len(x) // 4 for x in ids])
            with store.open_output_stream(f"{base}/{path}") as f:
                f.write(file_bytes(own, counts, np.frombuffer(b"".join(ids), "<u4")))
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(own)], "n_ids": [held]})
            ids, own, held, seq = [], [], 0, seq + 1
            release()
            return row

        for b in slices(batches, "text", 1 << 20):
            for d, x in zip(b.column("doc_id").to_pylist(), units.encode(b.column("text").to_pylist()), strict=True):
                own.append(d)
                ids.append(x + tail)
                held += len(ids[-1]) // 4
                if held >= file_ids:
                    yield flush()
        if own:
            yield flush()

    return stored(rows.mapInArrow(run, "path string, part int, seq int, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """The documents of token files in their order: doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit).

    files: what write() returned; without files there are no documents. Starts are summed within each
    part of the writing, then over the parts. Files are dealt out evenly, whole; a very long text is a
    file of its own.
    """
    spark = files.sparkSession
    # sums within a part first; only the parts, one row each, are summed in one task
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = files.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("t")).select("p", F.coalesce(before, F.lit(0)).alias("before"))
    listed = files.join(parts, F.col("part") == F.col("p")).select("path", (F.col("before") + F.coalesce(inside, F.lit(0))).alias("start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, name = open_store(path)
                with store.open_input_file(name) as f:
                    file = TokenFile(f.read())
                stops, ids = np.cumsum(file.counts), file.ids(0, file.n).astype("<u4").tobytes()
                held, docs, starts = [], [], []
                size = 0
                for d, stop, n in zip(file.docs, stops.tolist(), file.counts.tolist(), strict=True):
                    docs.append(d)
                    starts.append(start + stop - n)
                    held.append(ids[4 * (stop - n) : 4 * stop])
                    size += 4 * n
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "start", "ids"])
                        held, docs, starts, size = [], [], [], 0
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "start", "ids"])
                del file, stops, ids, held, docs, starts
                release()

    return listed.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, words: bool, end: int) -> DataFrame:
    """Writes the files into the shared folder, reads them back, and returns doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_path(docs.sparkSession, "vpfor")
    return read(write(docs, folder, tokenizer, words, end)).select("doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
