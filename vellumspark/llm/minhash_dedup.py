"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, bands, exact checks, components.

A shingle that occurs n times weighs 1 + ln n. Texts are similar if the probability Jaccard similarity
of their weighted shingles is high enough, or that of the same shingles at equal weights, which is the
plain Jaccard similarity of the sets: a passage that one text repeats more often than another parts
the two measures. So a text that repeats a shingle is signed under both weightings; for all others
they are one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import connected_components, drop_stored, release, slices, small_batches, stored
from vellumspark.llm.words import M1, mix, word_hashes

WORDS = 5
LEAST = 0.8
#: Bands and registers of each; a pair that is 0.8 similar shares no band with a chance of 3e-6.
BANDS, ROWS = 24, 4
#: Shingles whose texts are compared at once.
COLUMNS = 4096
#: Classes of a band bucket, and bytes of their shingles, that are compared at once after the first round.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Most ids of documents to check that are broadcast (16 MB); beyond it, texts are joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Most rows of counts of mixed buckets that are broadcast (about 8 MB); beyond it, Spark splits hot keys of the joins.
BROADCAST_ROWS = 1 << 17
#: Bytes of text that are signed together.
SIGN_BYTES = 1 << 20


def shingles(texts: list[str], words: int = WORDS) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """Of each text: a digest of its words, its distinct shingles' hashes in rising order, and their counts.

    Words are what stands between white space. A text of fewer words than a shingle has one shingle
    of all of them; one without words has none.
    """
    lists = [t.split() for t in texts]
    h = word_hashes(lists)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for i in range(words):
            rolled = mix(rolled * M1 + h[i : len(h) - words + 1 + i] + np.uint64(i + 1))
    out, at = [], 0
    for ws in lists:
        own = h[at : at + len(ws)]
        if len(ws) >= words:
            s, n = np.unique(rolled[at : at + len(ws) - words + 1], return_counts=True)
        elif len(ws):
            s, n = np.array([int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little")], np.uint64), np.array([1])
        else:
            s, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        out.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), s, n))
        at += len(ws)
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """ProbMinHash: a row of `size` registers per set of (elements, weights).

    Each element is a Poisson process whose rate is its weight: its points come one after another,
    each at a random register, which keeps the element of its earliest point. An element stops as
    soon as its next point is later than the latest of its set's registers. Two registers are equal
    with a chance of the sets' probability Jaccard similarity. All sets advance point by point
    together. A set without elements gets zeros.
    """
    counts = np.array([len(e) for e, _ in sets])
    kept = np.zeros(len(sets) * size, np.uint64)
    first = np.full(len(sets) * size, np.inf)
    if not counts.sum():
        return kept.reshape(-1, size)
    element = np.concatenate([e for e, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), counts)
    time = np.zeros(len(element))
    step = 0
    with np.errstate(over="ignore"):
        while len(element):
            r = mix(element + M1 * np.uint64(2 * step + 1))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight
            place = owner * size + ((mix(r + M1) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            sooner = time < first[place]
            p, t, e = place[sooner], time[sooner], element[sooner]
            np.minimum.at(first, p, t)
            best = t == first[p]
            kept[p[best]] = e[best]
            step += 1
            if step < 8 or step % 4 == 0:
                latest = first.reshape(-1, size).max(axis=1)
                on = time < latest[owner]
                element, weight, owner, time = element[on], weight[on], owner[on], time[on]
    return kept.reshape(-1, size)


def weights(counts: np.ndarray) -> np.ndarray:
    """Of shingles that occur so often."""
    return 1 + np.log(counts)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two rising arrays of distinct values."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of rising distinct elements a, b of weights x, y: the sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    With the common elements in order of x_j / y_j, the greater quotient is the first one from i on
    and the second one before it, so running sums of both give all inner sums.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    p, q = x[i], y[j]
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    left = x.sum() - np.cumsum(p) + p  # only in a, or common from here on
    right = y.sum() - q[::-1].cumsum()[::-1]  # only in b, or common before
    return float((1 / (left / p + right / q)).sum())


class Shingles:
    """A stored text's distinct shingles and, if some repeat, their weights."""

    def __init__(self, s: bytes, n: bytes | None):
        self.s = np.frombuffer(s, np.uint64)
        self.n = np.frombuffer(n, np.int32) if n else None

    @property
    def w(self) -> np.ndarray:
        return np.ones(len(self.s)) if self.n is None else weights(self.n)

    def like(self, other: Shingles, least: float) -> bool:
        """Similar under either weighting."""
        if jaccard(self.s, other.s) >= least:
            return True
        return (self.n is not None or other.n is not None) and probability_jaccard(self.s, self.w, other.s, other.w) >= least


def _sets(docs: DataFrame, ids: DataFrame, words: int, name: str) -> DataFrame:
    """id, s (its distinct shingles, rising) and n (how often each occurs, null if once) of the documents whose ids are listed, stored."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text", SIGN_BYTES):
            made = shingles([t or "" for t in b.column("text").to_pylist()], words)
            cols = [pa.array([s.tobytes() for _, s, _ in made], pa.binary()), pa.array([n.astype(np.int32).tobytes() if (n > 1).any() else None for _, _, n in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["id", "s", "n"])
        release()

    return stored(texts.select("doc_id", "text").mapInArrow(sets, "id long, s binary, n binary"), f"{name}-sets")


def _verified(docs: DataFrame, pairs: DataFrame, least: float, words: int, name: str) -> DataFrame:
    """Pairs (a, b) whose texts are similar under either weighting, stored."""
    ids = stored(pairs.selectExpr("a as id").union(pairs.selectExpr("b as id")).distinct(), f"{name}-ids")
    held = _sets(docs, ids, words, name)
    both = pairs.join(held.selectExpr("id as b", "s as sb", "n as nb"), "b").join(held.selectExpr("id as a", "s as sa", "n as na"), "a")

    def check(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            same = [Shingles(x, m).like(Shingles(y, n), least) for x, m, y, n in zip(*(b.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(same, pa.bool_()))
        release()

    out = stored(both.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(check, "a long, b long"), f"{name}-links")
    drop_stored(held)
    drop_stored(ids)
    return out


def _common(sets: list[Shingles]) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each two texts share, and what share of the first one's weight those have."""
    out, share = np.zeros((2, len(sets), len(sets)), np.float32)
    own = [x.w for x in sets]
    weight = np.concatenate([w / w.sum() if len(w) else w for w in own]).astype(np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x.s) for x in sets])
    _, back, n = np.unique(np.concatenate([x.s for x in sets]), return_inverse=True, return_counts=True)
    column = (np.cumsum(n > 1) - 1)[back]
    shared = np.flatnonzero(n[back] > 1)
    shared = shared[np.argsort(column[shared], kind="stable")]
    column, owner, weight = column[shared], owner[shared], weight[shared]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [at, at + COLUMNS])
        m, w = np.zeros((2, len(sets), COLUMNS), np.float32)
        m[owner[s:e], column[s:e] - at] = 1
        w[owner[s:e], column[s:e] - at] = weight[s:e]
        out += m @ m.T
        share += w @ m.T
    return out.astype(np.int64), share


def near_duplicates(docs: DataFrame, least: float = LEAST, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, component_id and kept of each row of docs (doc_id long, text; other columns are ignored).

    Documents are linked if their shingles are similar by `least` or more, either with weights of
    1 + ln(occurrences) by probability Jaccard, or as sets by Jaccard; component_id is the smallest
    doc_id that links reach, and kept tells whether it is the row's own. A null text is empty; texts
    without words are copies of one another, and so are texts of equal words; ties can't arise. Rows
    that share a doc_id stand for one vertex: links of either text hold for both. Rows without a doc_id
    take the component of their copies; if there are none, they are linked with nothing, have a null
    component and are kept. An empty table gives an empty one; a very long text is signed in one task.

    Copies form a class first and go on as one. Each band bucket then compares its classes with its
    least one; that settles groups of many similar texts without their pairs. In buckets that still
    hold more than one component, classes of different components are compared in blocks, on the whole
    texts' shingles. A block of a large component meets no other block of that component, so beside one
    great component the work grows in proportion. Only links that join components leave a meeting.
    Similar texts are missed only if they share no band.
    """
    size = bands * rows
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text", SIGN_BYTES):
            made = shingles(b.column("text").to_pylist(), words)
            sig = signatures([(s, weights(n)) for _, s, n in made], size).astype(np.uint32)
            odd = [i for i, (_, _, n) in enumerate(made) if (n > 1).any()]
            even = dict(zip(odd, signatures([(made[i][1], np.ones(len(made[i][1]))) for i in odd], size).astype(np.uint32), strict=True))
            cols = [pa.array([k for k, _, _ in made], pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([even[i].tobytes() if i in even else None for i in range(len(made))], pa.binary())]
            sizes = pa.array([len(s) for _, s, _ in made])
            del made, sig, even
            release()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, sizes], ["doc_id", "key", "sig", "even", "size"])

    signed = stored(base.mapInArrow(sign, "doc_id long, key binary, sig binary, even binary, size long"), "doc-signatures")
    classes = stored(signed.groupBy("key").agg(F.min("doc_id").alias("rep")), "doc-classes")
    own = ["sig", "even", "size"]
    reps = signed.join(classes.where("rep is not null"), (signed["key"] == classes["key"]) & (signed["doc_id"] == classes["rep"]))
    reps = stored(reps.select("rep", signed["key"], *own).dropDuplicates(["rep", "key"]).select("rep", *own), "doc-reps")

    both = reps.select("rep", "size", "sig").union(reps.where("even is not null").select("rep", "size", "even"))
    band = both.select("rep", "size", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("i"), "sig")
    band = band.select("rep", "size", F.col("i").alias("band"), F.xxhash64("i", F.expr(f"substring(sig, i * {4 * rows} + 1, {4 * rows})")).alias("bucket"))
    leads = band.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(band.join(leads, "bucket"), "doc-members")  # a text of two signatures may stand twice in a bucket
    pairs = members.where("rep <> lead").selectExpr("lead as a", "rep as b").distinct()
    pairs = stored(pairs, "doc-pairs")
    found = _verified(base, pairs, least, words, "doc-first")
    component = connected_components(found, "doc-components")
    made = [signed, classes, reps, members, pairs, found, component]

    settled = members.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "band", "rep", "size", "lead", F.coalesce("component", "rep").alias("component"))
    mixed = settled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y and n > 2")
    open_ = stored(settled.join(mixed.select("bucket"), "bucket").where("rep <> lead").drop("lead"), "doc-open")
    made.append(open_)
    some = open_.limit(1).count() > 0
    placed = stored(_meetings(open_), "doc-placed")
    held = _sets(base, open_.select(F.col("rep").alias("id")).distinct(), words, "doc-open") if some else None
    rest = placed if held is None else placed.join(reps.select("rep", "sig"), "rep").join(held, F.col("rep") == F.col("id")).drop("id")
    rest = rest.repartition(F.xxhash64("bucket", "i", "j")).sortWithinPartitions("bucket", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([held, table]) if held is not None else table
            starts = _starts(table)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield from meet(table.slice(s, e - s))
            held = table.slice(starts[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield from meet(held)
        release()

    def _starts(table: pa.Table) -> list[int]:
        cols = np.stack([np.asarray(table[c].combine_chunks()).astype(np.int64) for c in ("bucket", "i", "j")])
        return np.flatnonzero(np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)])).tolist()

    def meet(table: pa.Table):
        rep, component, own, i, j, at_band = (np.asarray(table[c].combine_chunks()) for c in ("rep", "component", "own", "i", "j", "band"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, size)
        sets = [Shingles(x, m) for x, m in zip(table["s"].to_pylist(), table["n"].to_pylist(), strict=True)]
        before = np.zeros((len(rep), len(rep)), bool)  # pairs that an earlier band compares
        for k in range(int(at_band[0])):
            whole = np.ones((len(rep), len(rep)), bool)
            for c in range(rows * k, rows * k + rows):
                whole &= sig[:, c][:, None] == sig[:, c][None, :]
            before |= whole
        hit = (component[:, None] != component[None, :]) & ~before
        if i[0] != j[0]:
            hit &= own[:, None] != own[None, :]
        hit = np.triu(hit, 1)
        some = np.flatnonzero(hit.any(axis=0) | hit.any(axis=1))
        if not len(some):
            return
        hit = hit[np.ix_(some, some)]
        sets = [sets[x] for x in some]
        lens = np.array([len(x.s) for x in sets])
        common, share = _common(sets)
        plain = hit & (lens > 0) & (common >= least * (lens[:, None] + lens[None, :] - common))
        repeats = np.array([x.n is not None for x in sets])
        # probability Jaccard is at most the common shingles' share of either text's weight
        perhaps = hit & ~plain & (repeats[:, None] | repeats[None, :]) & (np.minimum(share, share.T) >= least - 1e-4)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        found = []
        for sure, which in ((True, plain), (False, perhaps)):
            for m, n in zip(*(k.tolist() for k in np.nonzero(which)), strict=True):
                a, x = some[m], some[n]
                p, q = top(int(component[a])), top(int(component[x]))
                # what has met already needs no further link
                if p != q and (sure or sets[m].like(sets[n], least)):
                    up[max(p, q)] = min(p, q)
                    found.append((int(rep[a]), int(rep[x])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([x for _, x in found])], ["a", "b"])

    if some:
        more = stored(rest.mapInArrow(compare, "a long, b long").distinct(), "doc-more")
        if more.limit(1).count():
            component = connected_components(found.union(more), "doc-components")
        made += [held, more, component]
    made.append(placed)

    done = stored(classes.join(component.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("component_id")), "doc-done")
    out = signed.select("doc_id", "key").join(done, F.col("key") == F.col("k"))
    out = stored(out.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")), "doc-out")
    for x in (*made, done):
        drop_stored(x)
    return out.select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("__i")).drop("__i")


def _meetings(open_: DataFrame) -> DataFrame:
    """Classes of mixed buckets with the pairs of blocks (i, j) that they meet in.

    open_: bucket, band, rep, size, component. A component of more than BLOCK classes, or whose
    shingles take more than BLOCK_BYTES, has blocks of its own in the bucket; the others share the
    bucket's first blocks. All blocks meet, but for those of one component.
    """
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(8 * size / BLOCK_BYTES)).cast("int")
    rows = open_.dropDuplicates(["bucket", "rep"])
    per = stored(rows.groupBy("bucket", "component").agg(blocks(F.count(F.lit(1)), F.sum("size")).alias("k"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "doc-per")
    large = F.when(F.col("k") > 1, F.struct("component", "k"))
    small = [F.sum(F.when(F.col("k") == 1, F.col(c))) for c in ("n", "size")]
    info = per.groupBy("bucket").agg(F.coalesce(blocks(*small), F.lit(0)).alias("pool"), F.sort_array(F.collect_list(large)).alias("large"))
    if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # info has no more entries than per
        per, info = F.broadcast(per), F.broadcast(info)
    rows = rows.join(per.select("bucket", "component", "k"), ["bucket", "component"]).join(info, "bucket")
    rows = rows.withColumn("parts", F.col("pool") + F.aggregate("large", F.lit(0), lambda a, x: a + x["k"]))
    first = F.col("pool") + F.aggregate(F.filter("large", lambda x: x["component"] < F.col("component")), F.lit(0), lambda a, x: a + x["k"])
    first = F.when(F.col("k") > 1, first).otherwise(0)
    rows = rows.withColumn("first", first).withColumn("own", F.when(F.col("k") > 1, F.col("first") + F.pmod(F.xxhash64("rep"), F.col("k"))).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("pool", F.lit(1)))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: (F.col("k") == 1) | (x < F.col("first")) | (x >= F.col("first") + F.col("k")))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("bucket", "band", "rep", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def expected_miss(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that a pair shares no band."""
    return math.pow(1 - similarity**rows, bands)
