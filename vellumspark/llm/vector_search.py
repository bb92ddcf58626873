"""Exact top-k search by inner product over multi-resolution segment statistics.

A vector is cut into segments, coarse ones first, then finer ones. For each segment the inner product
of two vectors is the product of means times the length, plus at most the product of deviations times
the length, which also bounds their distance from below. Vectors whose bound stays under a query's
k-th score so far are dropped level by level; only the survivors' whole products are computed.

Vectors stay where they are and are taken in slots; the queries are few beside them and lie in files,
in blocks, each with a score that its k-th best reaches at least (found on a part of the vectors). A
slot's envelope, the extremes of its segment statistics, bounds all of its products with a query at
once: queries that it can't reach never meet the slot's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import open_store, stored, whole_uri

#: Segments of each level, coarse to fine.
LEVELS = (4, 16)
#: Vectors and queries that meet in one task at once.
SLOT_ROWS, QUERY_ROWS = 16384, 1024
#: Vectors, about, that give each query the score that it must reach.
FIRST_ROWS = 4096
#: If a larger share of a slot's vectors than this is left, all whole products are made at once.
DENSE = 0.1


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of each segment, both times the root of its length: the product of two such rows bounds the inner product from above."""
    width = -(-x.shape[1] // segments)
    x = np.pad(x, ((0, 0), (0, width * segments - x.shape[1]))).reshape(len(x), segments, width)
    return np.concatenate([x.mean(axis=2), x.std(axis=2)], axis=1) * width**0.5


def _floats(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether doubles hold every product and sum exactly."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2.0**53


class Envelope:
    """Extremes of the segment statistics of many vectors: least and greatest means, greatest deviations."""

    def __init__(self, stats: np.ndarray):
        half = stats.shape[1] // 2
        self.low, self.high, self.dev = stats[:, :half].min(axis=0), stats[:, :half].max(axis=0), stats[:, half:].max(axis=0)

    def bound(self, stats: np.ndarray) -> np.ndarray:
        """No product of one of the vectors with the vector of a row of stats is greater."""
        half = stats.shape[1] // 2
        mean, dev = stats[:, :half], stats[:, half:]
        return np.maximum(mean * self.low, mean * self.high).sum(axis=1) + dev @ self.dev


class Slot:
    """Vectors of integers, rows of x, with their statistics; pruned and met count (query, vector) pairs."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: tuple[int, ...] = LEVELS):
        self.ids, self.x = ids, x
        floats = x.astype(np.float64)
        self.levels = [s for s in levels if s < x.shape[1]] or [1]
        self.stats = [segment_stats(floats, s) for s in self.levels]
        self.envelope = Envelope(self.stats[0])
        self.norm = np.linalg.norm(floats, axis=1).max(initial=0)
        self.floats = floats
        self.pruned = self.met = 0

    def search(self, query_ids: np.ndarray, y: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows y of integers, the k best of the vectors that score `reach` or more: places in y, ids, scores. Ids equal to the query's are left out; ties go to the lesser id."""
        exact = _floats(self.x, y)
        ys = y.astype(np.float64)
        stats = [segment_stats(ys, s) for s in self.levels]
        slack = 1e-9 * self.norm * np.linalg.norm(ys, axis=1) + 1e-6
        least = reach - slack
        q = np.flatnonzero(self.envelope.bound(stats[0]) >= least)
        self.pruned += (len(y) - len(q)) * len(self.ids)
        if not len(q):
            return q, q, q
        left = stats[0][q] @ self.stats[0].T >= least[q][:, None]
        for own, other in zip(self.stats[1:], stats[1:], strict=True):
            if left.mean() > DENSE:
                break
            a, b = np.nonzero(left)
            left[a, b] = np.einsum("ij,ij->i", other[q[a]], own[b]) >= least[q[a]]
        self.met += int(left.sum())
        self.pruned += int(left.size - left.sum())
        if exact and left.mean() > DENSE:
            score = (ys[q] @ self.floats.T).astype(np.int64)
            left &= score >= reach[q][:, None]
            a, b = np.nonzero(left)
            score = score[a, b]
        else:
            a, b = np.nonzero(left)
            score = np.empty(len(a), np.int64)
            for s in range(0, len(a), 1 << 16):
                m, n = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                part = np.einsum("ij,ij->i", ys[q[m]], self.floats[n]) if exact else np.einsum("ij,ij->i", y[q[m]], self.x[n])
                score[s : s + (1 << 16)] = part.astype(np.int64)
            fit = score >= reach[q[a]]
            a, b, score = a[fit], b[fit], score[fit]
        a = q[a]
        other = self.ids[b] != query_ids[a]
        a, b, score = a[other], b[other], score[other]
        order = np.lexsort((self.ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.searchsorted(a, a)
        top = np.arange(len(a)) - first < k
        return a[top], self.ids[b[top]], score[top]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


@lru_cache(maxsize=64)
def _queries(path: str) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries of a file by length of their vectors: ids, row marks, vectors, scores to reach. A worker keeps a few files' queries."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        table = pq.read_table(f)
    lens = np.asarray(table["n"].combine_chunks())
    out = []
    for n in np.unique(lens).tolist():
        own = table.filter(pa.array(lens == n))
        ids, row, reach = (np.asarray(own[c].combine_chunks()) for c in ("vec_id", "row", "reach"))
        out.append((n, ids, row, _matrix(own["v"]), reach))
    return out


#: A score that every product reaches.
NOTHING = -(2**63)


def _best(x: DataFrame, queries: DataFrame, k: int, levels: tuple[int, ...], slot_rows: int, query_rows: int) -> DataFrame:
    """query_id, row, vec_id, score: of each slot of the vectors, the k best for each query of a stored table that reach its score."""
    files = sorted(whole_uri(f) for f in queries.inputFiles())
    names = ["query_id", "row", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, slot_rows):
                part = b.slice(at, slot_rows)
                if held and size + part.num_rows > slot_rows:
                    yield from meet(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield from meet(pa.Table.from_batches(held))

    def meet(table: pa.Table):
        lens = np.asarray(table["n"].combine_chunks())
        for n in np.unique(lens).tolist():
            own = table.filter(pa.array(lens == n))
            slot = Slot(np.asarray(own["vec_id"].combine_chunks()), _matrix(own["v"]), levels)
            for path in files:
                for m, ids, row, y, reach in _queries(path):
                    for s in range(0, len(ids) if m == n else 0, query_rows):
                        part = slice(s, s + query_rows)
                        q, i, score = slot.search(ids[part], y[part], k, reach[part])
                        if len(q):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[part][q]), pa.array(row[part][q]), pa.array(i), pa.array(score)], names)

    return x.select("vec_id", "v", "n").mapInArrow(run, "query_id long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, levels: tuple[int, ...] = LEVELS, slot_rows: int = SLOT_ROWS, query_rows: int = QUERY_ROWS, first_rows: int = FIRST_ROWS) -> DataFrame:
    """The k highest inner products of each query with the other vectors, exactly.

    vectors, queries: vec_id (long), embedding (array of float or double); other columns are ignored.
    Components become floor(scale * x). Rows without an id and vectors that are null, empty or hold
    null, NaN or infinite components take no part; products are taken between vectors of one length
    only. Rows with the query's vec_id count as its own; repeated queries are answered once, repeated
    candidates count each; ties go to the lesser vec_id. Scores must fit 64 bits. Without vectors or
    queries the result is empty. Returns query_id, rank, vec_id, score.

    The queries are written to the shared folder, in files of a few thousand. The vectors are spread
    once and not copied: each task takes its own in slots and reads the queries. About first_rows of
    the vectors, taken by a hash, come first: the k-th score that a query has among them is what any
    other vector must reach, so of a slot only what may count goes on.
    """
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))

    def clean(df: DataFrame) -> DataFrame:
        fit = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") > 0))
        return fit.select("vec_id", ints.alias("v")).withColumn("n", F.size("v"))

    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = clean(vectors).repartition(spread, F.xxhash64("vec_id", "v"), F.rand(5))
    y = clean(queries).distinct().withColumn("row", F.xxhash64("v"))
    files = max(1, -(-queries.count() // (4 * query_rows)))
    y = stored(y.withColumn("reach", F.lit(NOTHING)).repartition(files, "vec_id"), "top-queries")
    share = max(1, -(-vectors.count() // first_rows))
    if share > 1:
        chosen = x.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)
        first = _ranked(_best(chosen, y, k, levels, slot_rows, query_rows), k).where(F.col("rank") == k)
        first = first.select(F.col("query_id").alias("__q"), F.col("row").alias("__r"), F.col("score").alias("__s"))
        y = y.join(first, (F.col("vec_id") == F.col("__q")) & (F.col("row") == F.col("__r")), "left")
        y = stored(y.select("vec_id", "v", "n", "row", F.coalesce("__s", "reach").alias("reach")).repartition(files, "vec_id"), "top-reach")
    return _ranked(_best(x, y, k, levels, slot_rows, query_rows), k).select("query_id", "rank", "vec_id", "score")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
