"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Buckets of a table are compared twice. First on sketches, a further SKETCH signs of each vector: only
these travel to the buckets, and a vector that is far from all others of a bucket drops out there. The
vectors themselves then travel to the buckets where they have a candidate, for exact cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import connected_components, drop_stored, stored
from vellumspark.llm.vector_search import usable

#: Chance to miss a pair that is exactly as similar as asked for: by the tables, and by the sketches.
MISS, SKETCH_MISS = 1e-4, 1e-6
#: Classes of a bucket, by chance, on average; sketches make comparing so many cheap.
CROWD = 256
#: Signs of a sketch.
SKETCH = 128
#: Vectors of a bucket that are compared at once; larger buckets are cut into blocks, and blocks meet in pairs.
BLOCK = 512
#: Most buckets whose sizes are broadcast (4 MB); beyond it they are joined by shuffle.
BROADCAST_BUCKETS = 1 << 17
#: Rows of a meeting that are compared with all others of it at once.
STRIP = 256
#: Cosines this close to the limit are decided by one rule, whatever block a pair meets in.
CLOSE = 1e-9
SEED = 20_240_229


def table_plan(n: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """Signs per table and tables: about CROWD vectors a bucket by chance, and as many tables as keep the chance to miss."""
    bits = min(40, max(4, round(math.log2(max(2, n) / CROWD))))
    hit = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - hit))) if hit < 1 else 1


def most_differences(least: float, miss: float = SKETCH_MISS, signs: int = SKETCH) -> int:
    """Signs that two vectors of cosine `least` differ in, but for a chance of `miss`."""
    p, over = math.acos(max(-1.0, min(1.0, least))) / math.pi, 1.0
    for k in range(signs + 1):
        over -= math.comb(signs, k) * p**k * (1 - p) ** (signs - k)
        if over <= miss:
            return k
    return signs


def sign_codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A code per row and table: the sides of `bits` hyperplanes that a seed and the length of the vectors decide."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((tables, bits, x.shape[1]))
    weights = (1 << np.arange(bits)).astype(np.int64)
    return np.stack([(x @ planes[t].T > 0) @ weights for t in range(tables)], axis=1)


def sketches(x: np.ndarray) -> np.ndarray:
    """SKETCH further signs per row, as 64-bit numbers."""
    planes = np.random.default_rng([SEED + 1, x.shape[1]]).standard_normal((SKETCH, x.shape[1]))
    return np.packbits(x @ planes.T > 0, axis=1).view(np.uint64)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs i < j within consecutive groups of these sizes."""
    starts = np.cumsum(sizes) - sizes
    end = np.repeat(starts + sizes, sizes)
    left = np.arange(len(end))
    more = end - left - 1
    i = np.repeat(left, more)
    first = np.cumsum(more) - more
    return i, i + 1 + np.arange(len(i)) - np.repeat(first, more)


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of links that suffice to connect all that the links connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
            kept.append(k)
    return kept


def links(vectors: DataFrame, least: float = 0.95, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Adds n_links, component_id and kept to rows of vec_id (long) and embedding.

    Rows link if the cosine in double precision is `least` or more. Rows without an id, and vectors
    that are null, empty, zero or hold null, NaN or infinite components, link with nothing and are
    kept as their own component; vectors of different lengths don't link; an empty table gives an empty
    one. Equal vectors form a class first, which goes through the rest once; a member of a class links
    with its other members and with all members of the linked classes. Every pair of classes that
    shares a code in some table is compared, and counted in the first such table; a pair at the limit is
    missed with a chance of miss + SKETCH_MISS. A bucket of more than `block` classes is cut into blocks
    whose pairs meet in tasks of their own; only counts and a spanning forest of each meeting's links
    leave it. A cosine at the limit is decided by the dot product against `least` times the root of the
    product of both squares, whichever meeting finds it.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    fit = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    classes = stored(rows.where(fit).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vec-classes")
    bits, tables = table_plan(classes.count(), least, miss)
    code = np.uint16 if bits <= 16 else np.uint64

    kind = np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def doubles(vectors: list[bytes]) -> np.ndarray:
        """The vectors, each times a power of two that keeps its squares finite: that changes no cosine."""
        x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])

    def coded(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            reps = b.column("rep")
            lens = np.diff(np.asarray(b.column("embedding").offsets))
            flat = np.asarray(b.column("embedding").flatten()).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(lens)])
            for n in np.unique(lens).tolist():
                own = np.flatnonzero(lens == n)
                x = np.stack([flat[at[i] : at[i] + n] for i in own])
                codes, signs = sign_codes(x, bits, tables).astype(code), sketches(x)
                kept = [r.tobytes() for r in x.astype(kind)]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [reps.take(take), pa.array([n] * len(own), pa.int32()), pa.array(kept, pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in signs], pa.binary()), b.column("n").take(take)],
                    ["rep", "len", "vector", "all", "codes", "sketch", "n"],
                )

    unit = stored(classes.mapInArrow(coded, "rep long, len int, vector binary, all binary, codes array<long>, sketch binary, n long"), "vec-codes")
    held = unit.select("rep", "len", "sketch", F.posexplode("codes").alias("t", "code"))
    sizes = stored(held.groupBy("len", "t", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "vec-buckets")
    few = sizes.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "t"), F.col("parts")).cast("int")
    placed = held.join(F.broadcast(sizes) if few else sizes, ["len", "t", "code"]).withColumn("parts", parts).withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["len", "t", "code", "i", "j"]
    placed = placed.select("rep", "sketch", "t", "code", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "len")
    limit = most_differences(least)

    def sift(batches: Iterator[pa.RecordBatch]):
        for table in _meetings(batches, group):
            own, i, j = (np.asarray(table[c].combine_chunks()) for c in ("own", "i", "j"))
            bits_of = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(own), -1)
            near = np.zeros(len(own), bool)
            for s in range(0, len(own), STRIP):
                part = bits_of[s : s + STRIP]
                apart = sum(np.bitwise_count(part[:, k][:, None] ^ bits_of[:, k][None, :]).astype(np.uint8) for k in range(bits_of.shape[1]))
                like = apart <= limit
                if i[0] != j[0]:
                    like &= own[s : s + STRIP][:, None] != own[None, :]
                else:
                    like[np.arange(len(part)), np.arange(s, s + len(part))] = False
                near[s : s + STRIP] |= like.any(axis=1)
            if near.any():
                yield from table.filter(pa.array(near)).select(["rep", "own", *group]).combine_chunks().to_batches()

    sifted = placed.repartition(F.xxhash64(*group)).sortWithinPartitions(*group).mapInArrow(sift, "rep long, own int, len int, t int, code long, i int, j int")
    met = sifted.join(unit.select("rep", "vector", "all", "n"), "rep").repartition(F.xxhash64(*group)).sortWithinPartitions(*group)

    def meet(batches: Iterator[pa.RecordBatch]):
        small, pairs = [], 0
        for table in _meetings(batches, group):
            if table.num_rows > 32:
                yield from large(table)
                continue
            small.append(table)
            pairs += table.num_rows * (table.num_rows - 1) // 2
            if pairs > 1 << 16:
                yield from several(small)
                small, pairs = [], 0
        if small:
            yield from several(small)

    def columns(table: pa.Table) -> tuple[np.ndarray, ...]:
        rep, n, t, own, i, j = (np.asarray(table[c].combine_chunks()) for c in ("rep", "n", "t", "own", "i", "j"))
        return rep, n, t, own, i != j, np.frombuffer(b"".join(table["all"].to_pylist()), code).reshape(len(rep), -1)

    def linked(x: np.ndarray, squares: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", x[a], x[b]) >= least * np.sqrt(squares[a] * squares[b])

    def squared(x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", x, x)

    def result(rep: np.ndarray, total: np.ndarray, a: np.ndarray, b: np.ndarray):
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rep[seen]), pa.array(total[seen].astype(np.int64)), pa.nulls(len(seen), pa.int64())], ["a", "links", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.nulls(len(a), pa.int64()), pa.array(rep[b])], ["a", "links", "b"])

    def several(tables: list[pa.Table]):
        """Small meetings together, vectors of one length at a time."""
        by: dict[int, list[pa.Table]] = {}
        for x in tables:
            by.setdefault(x["len"][0].as_py(), []).append(x)
        for own_tables in by.values():
            table = pa.concat_tables(own_tables).combine_chunks()
            rep, n, t, own, across, codes = columns(table)
            x = doubles(table["vector"].to_pylist())
            a, b = _pairs(np.array([y.num_rows for y in own_tables]))
            hit = (~across[a] | (own[a] != own[b])) & ((codes[a] == codes[b]).argmax(axis=1) == t[a])  # the first table in which the two meet
            a, b = a[hit], b[hit]
            hit = linked(x, squared(x), a, b)
            a, b = a[hit], b[hit]
            if len(a):
                kept = _forest(a, b)
                yield from result(rep, np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep)), a[kept], b[kept])

    def large(table: pa.Table):
        """One meeting, strip by strip."""
        rep, n, t, own, across, codes = columns(table)
        x = doubles(table["vector"].to_pylist())
        squares = squared(x)
        unit_x = x / np.sqrt(squares)[:, None]
        total, label, a_kept, b_kept = np.zeros(len(rep)), np.arange(len(rep)), [], []
        for s in range(0, len(rep), STRIP):
            cosine = unit_x[s : s + STRIP] @ unit_x.T
            a, b = np.nonzero(cosine >= least - CLOSE)
            value, a = cosine[a, b], a + s
            fit = a < b
            if across[0]:
                fit &= own[a] != own[b]
            a, b, value = a[fit], b[fit], value[fit]
            first = (codes[a] == codes[b]).argmax(axis=1) == t[0]
            a, b, value = a[first], b[first], value[first]
            sure = value >= least + CLOSE
            sure[~sure] = linked(x, squares, a[~sure], b[~sure])
            a, b = a[sure], b[sure]
            total += np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
            edges = np.searchsorted(a, np.arange(s, s + STRIP + 1))
            for k in range(STRIP):
                others = b[edges[k] : edges[k + 1]]
                new = others[label[others] != label[s + k]] if len(others) else others
                if len(new):
                    labels, at = np.unique(label[new], return_index=True)
                    a_kept.append(np.full(len(at), s + k))
                    b_kept.append(new[at])
                    label[np.isin(label, labels)] = label[s + k]
        if total.any():
            none = [np.empty(0, int)]
            yield from result(rep, total, np.concatenate(a_kept or none), np.concatenate(b_kept or none))

    found = stored(met.mapInArrow(meet, "a long, links long, b long"), "vec-links")
    component = connected_components(found.where("b is not null").select("a", "b"), "vec-components")
    counts = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    done = classes.join(counts, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    done = done.select(F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    done = stored(done, "vec-done")
    for x in (unit, sizes, found, classes):
        drop_stored(x)
    key = F.when(fit, F.col("embedding"))
    out = rows.withColumn("k", key).join(done, F.col("k") == F.col("e"), "left")
    component_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"))


def _meetings(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of sorted batches."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = pa.concat_tables([held, table]) if held is not None else table
        starts = _group_starts(table, group)
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(s, e - s)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _group_starts(table: pa.Table, group: list[str]) -> list[int]:
    cols = np.stack([np.asarray(table[c].combine_chunks()).astype(np.int64) for c in group])
    return np.flatnonzero(np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)])).tolist()
