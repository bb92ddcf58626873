"""Hierarchical packing of token ids into windows of several power-of-two lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import release, slices, small_batches
from vellumspark.llm.vocab import library_units

TIERS = (256, 512, 1024, 2048)
#: Tokens of one step group; each group takes sequences of one tier and holds as many tokens as any other.
STEP_TOKENS = 16 * 2048
#: Ids that a task gathers before it packs them.
CHUNK_IDS = 1 << 20


class Pool:
    """Pieces shorter than the longest window, by length; a bit set tells which lengths occur."""

    def __init__(self, most: int):
        self.by, self.bits, self.size = [[] for _ in range(most + 1)], 0, 0

    def add(self, piece: tuple[int, int, int]) -> None:
        n = piece[2] - piece[1]
        self.by[n].append(piece)
        self.bits |= 1 << n
        self.size += 1

    def take(self, n: int) -> tuple[int, int, int]:
        out = self.by[n].pop()
        if not self.by[n]:
            self.bits &= ~(1 << n)
        self.size -= 1
        return out

    def longest(self, most: int) -> int:
        """Greatest length up to `most`, or 0."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.bits & ((1 << (most + 1)) - 2) else 0

    def shortest(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of (document, from, to) pieces, and the pieces left over (none if last).

    Whole longest windows are cut off long documents. What remains is routed to the least tier that
    holds it. From the longest tier down, each document of a tier opens a window of that length; its
    gap takes the longest whole document of the shorter tiers that fits, again and again, and last
    the head of the shortest one, whose rest goes back to its own tier. So windows end full, and only
    the last one of a task isn't.
    """
    most = tiers[-1]
    windows: list[list[tuple[int, int, int]]] = []
    pool = Pool(most)
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= most:
            windows.append([(d, at, at + most)])
            at += most
        if n > at:
            pool.add((d, at, n))
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while pool.size and (n := pool.longest(tier)) > below:
            held = [pool.take(n)]
            gap = tier - n
            while gap and pool.size:
                m = pool.longest(gap)
                if m:
                    held.append(pool.take(m))
                    gap -= m
                else:
                    d, a, b = pool.take(pool.shortest())
                    held.append((d, a, a + gap))
                    pool.add((d, a + gap, b))
                    gap = 0
            if not gap:
                windows.append(held)
                continue
            for x in held:  # nothing is left to fill this gap
                pool.add(x)
            break
        if pool.size and sum(len(x) * n for n, x in enumerate(pool.by[: tier + 1])) < tier:
            break
    rest = [x for own in reversed(pool.by) for x in own]
    if not last:
        return windows, rest
    held, room = [], most
    for d, a, b in rest:
        while a < b:
            c = min(b, a + room)
            held.append((d, a, c))
            room -= c - a
            a = c
            if not room:
                windows.append(held)
                held, room = [], most
    if held:
        windows.append(held)
    return windows, []


def pack(docs: DataFrame, tokenizer: str, end: int | None = 1, tiers: tuple[int, ...] = TIERS, words: bool = False, chunk_ids: int = CHUNK_IDS, step_tokens: int = STEP_TOKENS, keep_units: int = 0) -> DataFrame:
    """Packs the encoded texts of all documents into sequences.

    docs: doc_id, text; other columns are ignored, whatever their names. A null text is empty and gives
    the `end` id alone (no row without `end`); a null doc_id stays null; repeated rows are packed each;
    a very long text is encoded whole, in one task, and cut into windows; an empty table gives no rows;
    ties between pieces of one length are settled by which came last. Returns a row
    per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, tier, step_group. A sequence is as long as its tier, but for the last of each task, whose
    tier is the longest and which needs padding. step_group deals the sequences of a tier into groups
    of step_tokens tokens each; a task's last group of a tier may be smaller. Every task packs its own
    documents, so there is no shuffle, and its ids start with its partition number, which a repeated
    task keeps. keep_units: encoded units that a worker's cache may hold, where memory is short.
    """
    tail = b"" if end is None else int(end).to_bytes(4, "little")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        units = library_units(tokenizer, words, keep_units)
        base = TaskContext.get().partitionId() << 32
        seq, by_tier = 0, dict.fromkeys(tiers, 0)
        held: list[tuple[object, bytes, int, int]] = []  # doc_id, ids from an offset on, that offset, tokens in all
        size = 0

        def out(last: bool):
            nonlocal seq, held, size
            windows, rest = plan([len(x[1]) // 4 for x in held], tiers, last)
            cols: list[list] = [[] for _ in range(9)]
            for w in windows:
                at, n = 0, sum(b - a for _, a, b in w)
                tier = n if n in by_tier else tiers[-1]
                group = (base | by_tier[tier] // max(1, step_tokens // tier)) * len(tiers) + tiers.index(tier)
                by_tier[tier] += 1
                for d, a, b in w:
                    doc, ids, offset, total = held[d]
                    for c, v in zip(cols, (doc, offset + a, b - a, ids[4 * a : 4 * b], total, base | seq, at, tier, group), strict=True):
                        c.append(v)
                    at += b - a
                seq += 1
            held = [(held[d][0], held[d][1][4 * a : 4 * b], held[d][2] + a, held[d][3]) for d, a, b in rest]
            size = sum(len(x[1]) // 4 for x in held)
            for i in range(0, len(cols[0]), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 1024], t) for c, t in zip(cols, types, strict=True)], names)

        types = None
        for b in slices(batches, "text", 1 << 20):
            types = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            for doc, x in zip(b.column("doc_id").to_pylist(), units.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                x += tail
                held.append((doc, x, 0, len(x) // 4))
                size += len(x) // 4
                if size >= chunk_ids:
                    yield from out(False)
                    release()
        if held:
            yield from out(True)
        release()

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    return rows.mapInArrow(run, f"doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
