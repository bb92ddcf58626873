"""Quality by compression: texts that a dictionary of good texts shortens more than one of bad texts score high."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import release, slices, small_batches, stored

#: Labelled rows of each class to build a dictionary from, rows of each to calibrate on, and the bytes that are learned from a longer text.
GOOD_ROWS, BAD_ROWS, FIT_ROWS, MOST_BYTES = 1800, 600, 600, 16384
DICTIONARY_BYTES = 65536
#: Texts are compressed in pieces, as a long one would soon be its own dictionary.
PIECE, LEVEL = 1024, 3
#: Labels that are looked up for each that is learned from, as some have no text; the most that are broadcast (2 MB).
SPARE, BROADCAST_LABELS = 4, 1 << 17
#: Bytes of text whose difference counts half.
HALF = 128


@dataclass
class Model:
    good: bytes
    bad: bytes
    prior: float  # log odds of good labels
    weights: list[float]  # of how much the text counts, and of its difference as far as it counts


def _pieces(b: bytes, size: int) -> list[bytes]:
    return [b[i : i + size] for i in range(0, len(b), size)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts' end themselves if there are too few to train on."""
    samples = [p for t in texts for p in _pieces(t, 1024)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Features:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)
        self.frame = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress(b""))

    def difference(self, text: str) -> tuple[float, int]:
        """By how much a byte of the text the bad dictionary's result is larger than the good one's, and the bytes."""
        b = text.encode()
        parts = _pieces(b, PIECE)
        good = sum(len(self.good.compress(p)) - self.frame for p in parts)
        bad = sum(len(self.bad.compress(p)) - self.frame for p in parts)
        return (bad - good) / max(1, len(b)), len(b)

    def __call__(self, text: str) -> list[float]:
        """How much the text counts, from 0 for an empty one towards 1, and the difference as far as it counts."""
        d, n = self.difference(text)
        return [n / (n + HALF), 10 * d * n / (n + HALF)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float) -> list[float]:
    """Regularised logistic regression by Newton's method, its constant given."""
    w = np.zeros(x.shape[1])
    ridge = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w.tolist()


def _limit(wanted: int, n: int) -> int:
    """The hash up to which SPARE times as many of n rows lie as are wanted, or the greatest one."""
    return 2**63 - 1 if SPARE * wanted >= n else int((SPARE * wanted / n - 0.5) * 2**64)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, good_rows: int = GOOD_ROWS, bad_rows: int = BAD_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from at most good_rows + bad_rows + 2 * fit_rows labelled documents, of each its first MOST_BYTES bytes.

    labels: doc_id, quality (1 good, 0 bad). Rows whose crc32(doc_id as text) mod 3 is 1 are never
    read. The rows taken are those of least hash that have a text, so a run repeats another. The
    compressed-size difference by a byte is calibrated to the log odds of good labels: a text counts
    by n / (n + HALF) for its n bytes, so that one without bytes keeps the odds of the labels
    themselves. With labels of one class or none, every text scores the share of good labels, or 0.5.
    """
    fit = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    shares = {r.quality: r.n for r in fit.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {1: good_rows + fit_rows, 0: bad_rows + fit_rows}
    # labels of which only the least hashes can count: some times as many as are taken, however many there are
    least = F.when(F.col("quality") == 1, F.lit(_limit(wanted[1], shares.get(1, 0)))).otherwise(F.lit(_limit(wanted[0], shares.get(0, 0))))
    marked = fit.where(F.xxhash64("doc_id") <= least).groupBy("doc_id").agg(F.max("quality").alias("q"))
    marked = stored(marked.withColumn("k", F.xxhash64("doc_id")), "quality-labels")
    few = marked.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    some = docs.select(F.col("doc_id").alias("id"), F.substring(F.col("text").cast("binary"), 1, MOST_BYTES).alias("b"), F.xxhash64("text").alias("h")).where(F.length("b") > 0)
    found = some.join(F.broadcast(marked) if few else marked, F.col("id") == F.col("doc_id"))
    found = stored(found.select("q", "k", "id", "h", "b").distinct(), "quality-texts")
    texts = {q: [bytes(r.b) for r in found.where(F.col("q") == q).orderBy("k", "id", "h").limit(n).select("b").collect()] for q, n in wanted.items()}
    good, bad = texts[1], texts[0]
    if not good or not bad:
        share = 0.5 if not good and not bad else float(bool(good))
        return Model(b"", b"", float(np.log((share + 1e-3) / (1 - share + 1e-3))), [0.0, 0.0])
    prior = shares[1] / (shares[1] + shares[0])
    at = [min(n, max(1, len(t) // 2)) for t, n in ((good, good_rows), (bad, bad_rows))]
    model = Model(_dictionary(good[: at[0]]), _dictionary(bad[: at[1]]), float(np.log(prior / (1 - prior))), [])
    features = Features(model.good, model.bad)
    good_fit, bad_fit = (t[a : a + fit_rows] or t for t, a in ((good, at[0]), (bad, at[1])))
    x = np.array([features(t.decode("utf-8", "ignore")) for t in [*good_fit, *bad_fit]])
    y = np.array([1.0] * len(good_fit) + [0.0] * len(bad_fit))
    model.weights = _logistic(x, y, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())), model.prior)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds (or replaces) `name`: between 0 and 1, the higher the likelier good. The whole text alone decides; a null text is empty; a text without bytes scores the share of good labels. Repeated rows score alike; an empty table gives an empty one. No shuffle."""
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*kept)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        features, w = Features(model.good, model.bad), np.array(model.weights)
        for b in slices(batches, text):
            z = model.prior + np.array([features(t or "") for t in b.column(text).to_pylist()]).reshape(-1, 2) @ w
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p)], [*kept, name])
        release()

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(0.0)).schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; held_out is false for a null doc_id."""
    done = score(docs.select("doc_id", "text"), model)
    return done.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
