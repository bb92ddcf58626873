"""Byte-level BPE by merge replay over the distinct words of the whole corpus.

Texts are cut into matches of the vocabulary's pattern, block by block; a block keeps its texts as
places in a list of its distinct matches. Every block sends that list, once per match, to parts of
the matches' hashes. A part replays the merges over its distinct matches: they form flat sequences of
byte tokens, an inverted index holds, for each rank, the positions whose token and right neighbour
join to that rank, ranks are taken from a heap in rising order, all positions of a rank are merged
left to right, and only the pairs with the touched neighbours are looked up and indexed anew. Words
don't influence each other, so a part in slices gives what one index over the corpus would. The ids
go back to the blocks that asked, which put the texts together. A match is replayed once, however
many blocks and texts hold it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.blocks import gather, packed, part_edges, risen, rising, runs, spread_out, squeezed, unpacked
from vellumspark.llm.common import fresh_path, open_store, release, slices, stored, whole_uri
from vellumspark.llm.units import BOUNDARY
from vellumspark.llm.vocab import rank_file

#: Joins of token pairs that are remembered.
MOST_PAIRS = 1 << 18
#: Bytes of words that are replayed together.
REPLAY_BYTES = 1 << 20
#: Bytes of text after which a block ends; a longer text is a block of its own.
BLOCK_BYTES = 24 << 20
#: Words that a part holds on average, all blocks' lists taken together, and the least bits of a hash that are its part.
PART_WORDS, LEAST_BITS = 1 << 19, 6
#: Matches whose ids are put together at once.
AT_ONCE = 1 << 19
#: White space before a space (any of Unicode's): the pattern may take both together.
RISKY = "[\t-\r\x1c-\x20\x85\xa0  -     　] "


class MergeReplay:
    """ranks: token bytes to rank; a token's rank is its id. pattern: splits a text into matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.tokens = {r: b for b, r in ranks.items()}
        self.pairs: dict[int, int] = {}
        most = max(self.tokens, default=0) + 1
        self.lens = np.zeros(most, np.int64)
        self.lens[list(self.tokens)] = [len(b) for b in self.tokens.values()]
        self.starts = np.cumsum(self.lens) - self.lens
        self.letters = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)

    def _rank(self, a: int, b: int) -> int:
        """Rank that tokens a and b join to, or -1."""
        key = a << 32 | b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def one(self, word: bytes) -> list[int]:
        """Always the least rank first, its leftmost place first, for words where replay can't keep that order."""
        ids, rank = [self.single[b] for b in word], self._rank
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) >= 0]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j == n or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank(r, ids[k])) >= 0:
                    heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := rank(ids[h], r)) >= 0:
                heappush(heap, (s, h))
        return [x for x in ids if x >= 0]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the distinct words."""
        single, rank, pairs = self.single, self._rank, self.pairs
        token: list[int] = []
        starts = []
        for w in words:
            starts.append(len(token))
            token += [single[b] for b in w]
            token.append(-1)  # no pair spans words
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = token[i], token[i + 1]
            if a < 0 or b < 0:
                continue
            r = pairs.get(a << 32 | b)
            if r is None:
                r = rank(a, b)
            if r >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapify(heap)
        odd: set[int] = set()  # positions in words where a merge made a pair of lower rank
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for i in places:
                a = token[i]
                if a < 0:
                    continue
                j = after[i]
                b = token[j]
                if b < 0 or rank(a, b) != r:
                    continue
                token[i] = r
                token[j] = -2
                k = after[i] = after[j]
                before[k] = i
                c = token[k]
                if c >= 0:
                    s = pairs.get(r << 32 | c)
                    if s is None:
                        s = rank(r, c)
                    if s >= 0:
                        if s <= r:
                            odd.add(i)
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heappush(heap, s)
                h = before[i]
                if h >= 0 and (c := token[h]) >= 0:
                    s = pairs.get(c << 32 | r)
                    if s is None:
                        s = rank(c, r)
                    if s >= 0:
                        if s <= r:
                            odd.add(i)
                        if s in index:
                            index[s].append(h)
                        else:
                            index[s] = [h]
                            heappush(heap, s)
        out = [[x for x in token[s : s + len(w)] if x >= 0] for s, w in zip(starts, words, strict=True)]
        if odd:
            at = np.searchsorted(np.array(starts), sorted(odd), "right") - 1
            for i in set(at.tolist()):
                out[i] = self.one(words[i])
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word's after another's, and how many each has. Words of up to REPLAY_BYTES are replayed together."""
        out: list[list[int] | None] = [None] * len(words)
        todo, size = [], 0

        def replay():
            for i, ids in zip(todo, self.words([words[i] for i in todo]), strict=True):
                out[i] = ids

        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = [r]
                continue
            if todo and size + len(w) > REPLAY_BYTES:
                replay()
                todo, size = [], 0
            todo.append(i)
            size += len(w)
        replay()
        return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text's ids, without a cluster."""
        held = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        words = list({w for ws in held for w in ws})
        flat, n = self.encode_words(words)
        ends = np.cumsum(n)
        ids = {w: flat[e - k : e].astype("<u4").tobytes() for w, e, k in zip(words, ends.tolist(), n.tolist(), strict=True)}
        return [b"".join([ids[w] for w in ws]) for ws in held]

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes that ids stand for; ends: where each text's ids end."""
        if len(ids) and (int(ids.max()) >= len(self.lens) or not self.lens[ids].all()):
            raise ValueError("an id outside the vocabulary")
        data, at = gather(self.letters, self.starts, self.lens, ids)
        return _binary(data, np.concatenate([[0], at])[ends])

    def decode(self, ids: bytes) -> bytes:
        flat = np.frombuffer(ids, "<u4")
        return self.decode_many(flat, np.array([len(flat)]))[0].as_py()


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(rank_file(path), pattern)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of runs of bytes that end at these places."""
    offsets = np.concatenate([[0], ends])
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.array([data[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def _units(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a slice of texts: an order of them, and in that order their units, whether a space before each was cut off, and each text's number of units.

    No match spans a place between another character than white space and a space, so units may be
    cut there. Texts where a space follows white space are cut with more care, and come last.
    """
    risky = pc.match_substring_regex(texts, RISKY)
    mask = np.asarray(risky.to_numpy(zero_copy_only=False), bool)
    lists = pc.split_pattern(texts.filter(pc.invert(risky)), " ")
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    cut = np.ones(int(n.sum()), bool)
    cut[np.cumsum(n) - n] = False
    rest = [BOUNDARY.split(t) for t in texts.filter(risky).to_pylist()]
    more = pa.array([u for us in rest for u in us], pa.string())
    units = pa.concat_arrays([lists.flatten(), more])
    order = np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)])
    return order, units, np.concatenate([cut, np.zeros(len(more), bool)]), np.concatenate([n, [len(us) for us in rest]]).astype(np.int64)


class _Block:
    """Gathers units of texts until the block is full."""

    def __init__(self):
        self.kept, self.units, self.cut, self.counts, self.size = [], [], [], [], 0

    def add(self, kept: pa.RecordBatch, texts: pa.Array) -> None:
        order, units, cut, counts = _units(texts)
        self.kept.append(kept.take(pa.array(order)))
        self.units.append(units.dictionary_encode())
        self.cut.append(cut)
        self.counts.append(counts)
        self.size += texts.nbytes

    def finish(self, pattern: regex.Pattern) -> tuple[list[bytes], list[bytes], int]:
        """What the texts are (kept columns, matches of each, tokens, the words' order), what the words are (hashes, lengths, bytes), and how many.

        Words stand in the order of their hashes; tokens number them by how often they occur, so that most are small.
        """
        units = pa.chunked_array(self.units).unify_dictionaries()
        listed = units.chunk(0).dictionary
        code = np.concatenate([np.asarray(c.indices).astype(np.int64) for c in units.chunks]) * 2 + np.concatenate(self.cut)
        seen = np.zeros(2 * len(listed), bool)
        seen[code] = True
        codes = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1)[code]
        strings = listed.take(pa.array(codes >> 1)).to_pylist()
        matches = [pattern.findall(" " + u if c else u) for u, c in zip(strings, (codes & 1).tolist(), strict=True)]
        n = np.fromiter(map(len, matches), np.int64, len(matches))
        words = pa.array(chain.from_iterable(matches), pa.string()).dictionary_encode()
        del matches, strings
        names = words.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 32 for w in names), np.uint32, len(names))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens, ends = gather(rank[np.asarray(words.indices)], np.cumsum(n) - n, n, place)
        counts = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.concatenate(self.counts))])])
        common = np.argsort(-np.bincount(tokens, minlength=len(order)), kind="stable").astype(np.int32)
        rank[common] = np.arange(len(order))
        held = words.dictionary.take(pa.array(order)).cast(pa.binary())
        lens = np.asarray(pc.binary_length(held)).astype(np.int32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in self.kept:
                w.write_batch(b)
        texts = [sink.getvalue().to_pybytes(), packed(counts.astype(np.int64)), packed(rank[tokens].astype(np.int32)), packed(common)]
        return texts, [rising(hashes[order]), packed(lens), squeezed(b"".join(held.to_pylist()))], len(lens)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds a binary column `ids` (little-endian unsigned 32-bit) with the encoding of the whole text.

    A null or empty text gives no ids, and a text of any length is encoded whole, in one task. All
    other columns (or those of `keep`) stay as they are; a column named `ids` or `decoded` is
    replaced. Repeated rows are encoded alike; an empty table gives an empty one. decoded: a further
    column with the bytes that the ids stand for, read back from the ids. pattern: its matches don't
    span a place between another character than white space and a space.

    The blocks (texts as places in lists of matches, and kept columns) are written to files in the
    shared folder, one file a task; a task that runs again writes one of another name. Each block's
    distinct matches travel once to the part of their hashes and their ids once back; texts don't travel.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded)]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = docs.select(*kept).withColumn(ids, F.lit(b"").cast("binary"))
    schema = (schema.withColumn(decoded, F.lit(b"").cast("binary")) if decoded else schema).schema

    folder = whole_uri(fresh_path(spark, "bpe-texts"))

    def cut(batches: Iterator[pa.RecordBatch]):
        split, base, made, held = regex.compile(pattern), TaskContext.get().partitionId() << 32, 0, _Block()
        store, name = open_store(folder)
        store.create_dir(name)
        file = f"part-{base >> 32:06d}-{uuid.uuid4().hex[:12]}"
        with store.open_output_stream(f"{name}/{file}") as out:

            def row() -> pa.RecordBatch:
                texts, words, n = held.finish(split)
                at = out.tell()
                for x in texts:
                    out.write(x)
                cols = [pa.array([base + made]), pa.array([f"{folder}/{file}"]), pa.array([[at, *map(len, texts)]], pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array([x], pa.binary()) for x in words), pa.array([n])], ["block", "path", "places", "hashes", "lens", "data", "n"])

            for b in slices(batches, "__text"):
                if held.size and held.size + b.column("__text").nbytes > block_bytes:
                    yield row()
                    held, made = _Block(), made + 1
                held.add(b.select(kept), b.column("__text"))
            if held.kept:
                yield row()
        release()

    blocks = stored(rows.mapInArrow(cut, "block long, path string, places array<long>, hashes binary, lens binary, data binary, n long"), "bpe-blocks")
    words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    bits = max(LEAST_BITS, (words // PART_WORDS).bit_length())

    def send(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for block, hashes, lens, data in zip(*(b.column(c).to_pylist() for c in ("block", "hashes", "lens", "data")), strict=True):
                lens, data = unpacked(lens, np.int32), spread_out(data)
                edges, ends = part_edges(risen(hashes, np.uint32), bits), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                some = [(p, s, e) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
                cols = [pa.array([p for p, _, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64())]
                cols += [pa.array([packed(lens[s:e]) for _, s, e in some], pa.binary()), pa.array([squeezed(data[ends[s] : ends[e]]) for _, s, e in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "lens", "data"])

    def replay(batches: Iterator[pa.RecordBatch]):
        coder = _coder(path, pattern)
        for part, table in runs(batches, "part"):
            lens = [unpacked(x, np.int32) for x in table["lens"].to_pylist()]
            data = np.frombuffer(b"".join(map(spread_out, table["data"].to_pylist())), np.uint8)
            words = _binary(data, np.cumsum(np.concatenate(lens), dtype=np.int64)).dictionary_encode()
            flat, n = coder.encode_words(words.dictionary.to_pylist())
            starts, which = np.cumsum(n) - n, np.asarray(words.indices)
            at, cols, size = 0, [[], [], []], 0
            for block, own in zip(table["block"].to_pylist(), lens, strict=True):
                w = which[at : at + len(own)]
                at += len(own)
                got, _ = gather(flat, starts, n, w)
                for c, x in zip(cols, (block, packed(n[w].astype(np.int32)), packed(got)), strict=True):
                    c.append(x)
                size += len(cols[2][-1])
                if size > 1 << 20:
                    yield _answers(part, cols)
                    cols, size = [[], [], []], 0
            if cols[0]:
                yield _answers(part, cols)
            release()

    def _answers(part: int, cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([part] * len(cols[0]), pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["block", "part", "lens", "ids"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.select("block", "hashes", "lens", "data").mapInArrow(send, "part int, block long, lens binary, data binary")
    asked = asked.repartitionById(spread, F.pmod("part", F.lit(spread)).cast("int")).sortWithinPartitions("part")
    told = asked.mapInArrow(replay, "block long, part int, lens binary, ids binary")
    none = F.lit(None).cast("binary")
    both = blocks.select("block", F.lit(-1).alias("part"), none.alias("lens"), none.alias("ids"), "path", "places").unionByName(told.select("*", F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<long>").alias("places")))
    place = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * 31, F.lit(spread)).cast("int")
    both = both.repartitionById(spread, place).sortWithinPartitions("block", "part")

    def join(batches: Iterator[pa.RecordBatch]):
        coder = _coder(path, pattern)
        for _, table in runs(batches, "block"):
            own, (at, *sizes) = table["path"][0].as_py(), table["places"][0].as_py()
            store, name = open_store(own)
            with store.open_input_file(name) as f:
                f.seek(at)
                held = [f.read(k) for k in sizes]
            counts, tokens = unpacked(held[1], np.int64), unpacked(held[3], np.int32)[unpacked(held[2], np.int32)]
            answers = table.slice(1)
            n = np.concatenate([np.empty(0, np.int32), *(unpacked(x, np.int32) for x in answers["lens"].to_pylist())]).astype(np.int64)
            flat = np.concatenate([np.empty(0, np.uint32), *(unpacked(x, np.uint32) for x in answers["ids"].to_pylist())])
            starts, ends = np.cumsum(n) - n, np.cumsum(counts)
            rest = pa.ipc.open_stream(held[0]).read_all().combine_chunks()
            del answers, table, held
            at = 0
            while at < len(counts):
                before = int(ends[at] - counts[at])
                to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
                made, found = gather(flat, starts, n, tokens[before : int(ends[to - 1])])
                stops = np.concatenate([[0], found])[ends[at:to] - before]
                cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rest.slice(at, to - at).combine_chunks().columns]
                cols.append(_binary(made.astype("<u4").view(np.uint8), 4 * stops))
                if decoded:
                    cols.append(coder.decode_many(made, stops))
                yield pa.RecordBatch.from_arrays(cols, [*kept, ids, *([decoded] if decoded else [])])
                at = to
            release()

    return both.mapInArrow(join, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds (or replaces) a binary column `text` with the bytes that the ids stand for; null ids give no bytes. Ids outside the vocabulary are an error. No shuffle."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept).withColumn(text, F.lit(b"").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]):
        coder = _coder(path, pattern)
        for b in slices(batches, ids):
            held = [x or b"" for x in b.column(ids).to_pylist()]
            out = coder.decode_many(np.frombuffer(b"".join(held), "<u4"), np.cumsum([len(x) // 4 for x in held], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), out], [*kept, text])

    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; encodes, decodes the ids and hashes both natively."""
    d = encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded", keep=["doc_id"])
    return d.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
