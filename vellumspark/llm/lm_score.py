"""Cross-entropy difference: matched target and background bigram models over one vocabulary, their losses compared per token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.blocks import packed, part_edges, risen, rising, runs, unpacked
from vellumspark.llm.common import drop_shuffles, drop_stored, release, slices, stored
from vellumspark.llm.words import M1, mix, word_hashes

#: Weight of the unigram estimate in tokens, and of the uniform one in the unigram estimate.
BACKOFF, UNIFORM = 8.0, 0.5
#: Most target ids that are broadcast (8 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1 << 20


def _flagged(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, text and whether the row belongs to the target."""
    ids = targets.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.col("__id").isNotNull().alias("target"))


def _own(doc: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """How often each place's key occurs in its text."""
    _, back, n = np.unique(doc * size + key, return_inverse=True, return_counts=True)
    return n[back]


#: Words of the texts that are counted together as one block; a longer text is a block of its own.
BLOCK_WORDS = 1 << 20
#: The bits of a key that deal words and pairs to parts; with every further BLOCKS blocks there are more parts.
WORD_BITS, PAIR_BITS, BLOCKS = 6, 9, 4096


def _bits(n_blocks: int) -> tuple[int, int]:
    """Bits of words' and pairs' keys that are their part."""
    more = max(0, -(-n_blocks // BLOCKS) - 1).bit_length()
    return WORD_BITS + more, PAIR_BITS + more


def _blocks(rows: DataFrame) -> DataFrame:
    """The texts as blocks, stored: ids, numbers of words and targets of the texts, the block's distinct words (64-bit hashes, rising) and each word's place among them."""
    key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        part, made = TaskContext.get().partitionId(), 0
        ids, counts, target, hashes, held = [], [], [], [], 0

        def block():
            n, t = np.concatenate(counts), np.concatenate(target)
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            doc_ids = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            blobs = [pa.array([x], pa.binary()) for x in (packed(n), t.tobytes(), rising(words), packed(tokens.astype(np.int32)))]
            sums = [pa.array([int(x)]) for x in (n.sum(), n[t].sum(), (n > 0).sum(), (n[t] > 0).sum())]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), lists, *blobs, *sums], ["block", "ids", "counts", "target", "words", "tokens", "n", "n_target", "texts", "texts_target"])

        for b in slices(batches, "text"):
            lists = [t.lower().split() for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            if held and held + int(n.sum()) > BLOCK_WORDS:
                yield block()
                release()
                ids, counts, target, hashes, held, made = [], [], [], [], 0, made + 1
            ids.append(b.column("doc_id"))
            counts.append(n)
            target.append(np.asarray(b.column("target").to_pylist(), bool))
            hashes.append(word_hashes(lists))
            held += int(n.sum())
        if ids:
            yield block()

    return stored(rows.mapInArrow(run, f"block long, ids array<{key}>, counts binary, target binary, words binary, tokens binary, n long, n_target long, texts long, texts_target long"), "lm-blocks")


class _Block:
    """Of a stored block: texts, words and pairs, and how often the block itself has each, in the background and in the target."""

    def __init__(self, counts: bytes, target: bytes, words: bytes, tokens: bytes):
        self.counts, self.target = unpacked(counts, np.int64), np.frombuffer(target, bool)
        self.words, self.word = risen(words), unpacked(tokens, np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = np.zeros(len(self.word), bool)
        self.first[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = True
        self.before = np.concatenate([self.word[:1], self.word[:-1]])
        with np.errstate(over="ignore"):
            left = np.where(self.first, np.uint64(0), self.words[self.before])
            self.pairs, self.pair = np.unique(mix(left * M1 + self.words[self.word]), return_inverse=True)
        self.held = self.target[self.doc]

    def n(self, place: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(place, minlength=size), np.bincount(place[self.held], minlength=size)]).astype(np.int64)


def _totals(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """What all other blocks count of each block's words and pairs, stored: in the order of its keys, a row per part. Block -1 has the numbers of distinct words.

    A block's own counts are summed before they are sent, so a common word has one entry per block.
    """
    bits = _bits(n_blocks)
    word_parts = 1 << bits[0]

    def send(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                own = _Block(*(b.column(c)[i].as_py() for c in ("counts", "target", "words", "tokens")))
                for kind, keys, n in ((0, own.words, own.n(own.word, len(own.words))), (1, own.pairs, own.n(own.pair, len(own.pairs)))):
                    cuts = part_edges(keys, bits[kind])
                    some = [(p, s, e) for p, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
                    cols = [pa.array([p + kind * word_parts for p, _, _ in some], pa.int32()), pa.array([b.column("block")[i].as_py()] * len(some), pa.int64())]
                    cols += [pa.array([f(x[s:e]) for _, s, e in some], pa.binary()) for f, x in ((rising, keys), (packed, n[0]), (packed, n[1]))]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "block", "keys", "n", "n_target"])

    def add(batches: Iterator[pa.RecordBatch]):
        for part, table in runs(batches, "part"):
            keys = [risen(x) for x in table["keys"].to_pylist()]
            n = [[unpacked(x, np.int64) for x in table[c].to_pylist()] for c in ("n", "n_target")]
            cuts = np.cumsum([0, *map(len, keys)]).tolist()
            flat, own = np.concatenate(keys), np.stack([np.concatenate(x) for x in n])
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            lens = np.diff(np.concatenate([starts, [len(ranked)]]))
            sums = np.empty_like(own)
            sums[:, order] = np.repeat(np.add.reduceat(own[:, order], starts, axis=1), lens, axis=1)
            sums -= own
            out = [(-1, part, b"", b"", len(starts))] if part < word_parts else []
            for block, s, e in zip(table["block"].to_pylist(), cuts[:-1], cuts[1:], strict=True):
                if sums[:, s:e].any():
                    out.append((block, part, packed(sums[0, s:e]), packed(sums[1, s:e]), 0))
            if out:
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["block", "part", "n", "n_target", "words"])

    spread = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = blocks.mapInArrow(send, "part int, block long, keys binary, n binary, n_target binary")
    parts = parts.repartitionById(spread, F.pmod("part", F.lit(spread)).cast("int")).sortWithinPartitions("part")
    return stored(parts.mapInArrow(add, "block long, part int, n binary, n_target binary, words long"), "lm-totals")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of each row of docs (doc_id, text; other columns are ignored).

    The target model counts the documents whose doc_id occurs in targets, the background model all of
    docs, both every distinct lower-cased word between white space and every pair of neighbours, told
    apart by 64 bits. They share one vocabulary, the distinct words of docs, and are matched: the
    background's counts are scaled to the target's number of tokens, so what neither model has seen
    costs the same in both. Losses are mean negative log chances per token; score is the background's
    loss less the target's, higher for texts more like the target. A document's own counts are taken
    out of each model that holds it.

    A text without words, empty or null, has no tokens and zeros. Rows that share a doc_id are each
    scored, and each belong to the target if the id does; a null doc_id never does. Without targets
    (or with targets of no words) the background isn't scaled and the target model is uniform. An empty
    table gives an empty one. A very long text is a block of its own.

    What is gathered grows with the corpus: texts are stored as blocks, each block sends its own counts
    to parts of the keys, which send back what the other blocks count. No count is broadcast or collected.
    """
    spark = docs.sparkSession
    rows = _flagged(docs, targets)
    key = rows.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(rows)
    known = blocks.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_target", "texts", "texts_target")]).collect()[0]
    totals, starts, bits = known[1:3], known[3:5], _bits(known[0])
    scale = (totals[1] / totals[0] if totals[1] else 1.0, 1.0)
    sums = _totals(blocks, known[0])
    drop_shuffles(spark)  # before the second shuffle, which is as large
    size = sums.where("block = -1").agg(F.coalesce(F.sum("words"), F.lit(0))).collect()[0][0]
    own = ["ids", "counts", "target", "words", "tokens"]
    got = sums.where("block >= 0").select("block", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in own], "part", F.col("n").alias("more"), F.col("n_target").alias("more_target"))
    none = F.lit(None).cast("binary")
    both = blocks.select("block", *own, F.lit(None).cast("int").alias("part"), none.alias("more"), none.alias("more_target")).unionByName(got)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * 31, F.lit(spread)).cast("int")
    both = both.repartitionById(spread, place).sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]):
        for _, table in runs(batches, "block"):
            at = next(i for i, x in enumerate(table["tokens"].is_valid().to_pylist()) if x)
            b = _Block(*(table[c][at].as_py() for c in ("counts", "target", "words", "tokens")))
            words, pairs = b.n(b.word, len(b.words)), b.n(b.pair, len(b.pairs))
            cuts = [part_edges(b.words, bits[0]), part_edges(b.pairs, bits[1])]
            for part, n, n_target in zip(*(table[c].to_pylist() for c in ("part", "more", "more_target")), strict=True):
                if part is not None:
                    kind = int(part >= 1 << bits[0])
                    part -= kind << bits[0]
                    (words, pairs)[kind][:, cuts[kind][part] : cuts[kind][part + 1]] += np.stack([unpacked(n, np.int64), unpacked(n_target, np.int64)])
            own_word, own_pair = _own(b.doc, b.word, len(b.words)), _own(b.doc, b.pair, len(b.pairs))
            own_before = np.where(b.first, 1, np.concatenate([own_word[:1], own_word[:-1]]))
            losses = []
            for m in (0, 1):
                held = np.ones(len(b.doc), np.int64) if m == 0 else b.held.astype(np.int64)
                uni = (scale[m] * (words[m][b.word] - own_word * held) + UNIFORM) / (scale[m] * (totals[m] - b.counts[b.doc] * held) + UNIFORM * size)
                history = scale[m] * (np.where(b.first, starts[m], words[m][b.before]) - own_before * held)
                loss = -np.log((scale[m] * (pairs[m][b.pair] - own_pair * held) + BACKOFF * uni) / (history + BACKOFF))
                losses.append(np.bincount(b.doc, loss, len(b.counts)) / np.maximum(1, b.counts))
            ids = table["ids"].combine_chunks()[at].values
            cols = [ids, pa.array(b.counts), pa.array(losses[1]), pa.array(losses[0]), pa.array(losses[0] - losses[1])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    out = stored(both.mapInArrow(run, f"doc_id {key}, n_tokens long, target_loss double, background_loss double, score double"), "lm-scores")
    drop_stored(blocks)
    drop_stored(sums)
    return out
