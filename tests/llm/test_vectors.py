import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import queries, vector_dedup, vector_search
from vellumspark.llm.common import connected_components

NAN = float("nan")
ODD = [(1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [NAN, 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, []), (9, [2.0, 0.0, 1.0]), (10, [1.0, 0.0, 0.5, 0.0]), (None, [1.0, 0.0, 0.5]), (100, [1.0, 0.01, 0.5]), (200, [-1.0, 0.0, 0.0])]
SCHEMA = "vec_id long, embedding array<float>"


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def groups(seed=1, n=300, d=16):
    """Vectors around a few centres: exact copies, near copies, and pairs on either side of the threshold."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    rows = [c + r.standard_normal(d) * s for c in centres for s in (0, 0, 0.05, 0.1, 0.2, 0.25, 0.3)]
    rows += [centres[0] + r.standard_normal(d) * 0.15 for _ in range(n)]
    rows += list(r.standard_normal((n, d)))
    return [(i * 7, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_links_equal_brute_force(spark):
    rows = groups()
    df = spark.createDataFrame(rows, SCHEMA)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    for block in (512, 16):  # large buckets cut into blocks that meet in pairs
        got = {r.vec_id: r for r in vector_dedup.links(df, block=block, miss=1e-7).collect()}
        assert len(got) == len(rows) and near.sum() > 1000
        assert {i: got[i].n_links for i in ids} == dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
        assert {i: got[i].component_id for i in ids} == want
        assert all(got[i].kept == (want[i] == i) for i in ids)


def test_links_of_odd_rows(spark):
    got = vector_dedup.links(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(got) == len(ODD)
    by = {r.vec_id: r for r in got}
    assert [by[i].n_links for i in (1, 2, 9, 100)] == [3, 3, 3, 3] and {by[i].component_id for i in (1, 2, 9, 100)} == {1}
    for i in (3, 4, 5, 6, 7, 8, 10, 200):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[None].component_id is None and by[None].kept
    assert vector_dedup.links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_keep_to_their_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA).withColumn("n_links", F.lit("x")).withColumn("k", F.lit(1))
    assert [(r.vec_id, r.n_links) for r in vector_dedup.links(df).orderBy("vec_id").collect()] == [(1, 1), (2, 1)]


def test_sketches_keep_pairs_at_the_limit():
    """Of pairs whose cosine is just the limit, none differs in more signs than allowed; nearly all random pairs do."""
    r = np.random.default_rng(11)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = r.standard_normal(x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * other
    apart = lambda a, b: np.bitwise_count(vector_dedup.sketches(a) ^ vector_dedup.sketches(b)).sum(axis=1)
    limit = vector_dedup.most_differences(0.95)
    assert (apart(x, y) <= limit).mean() > 0.9995 and (apart(x, x[::-1]) <= limit).mean() < 0.01


def test_cosines_at_the_limit_are_decided_alike(spark):
    """Pairs at the limit and one step to either side, alone and in a crowd, by exact arithmetic."""
    from fractions import Fraction

    rows = [(0, [1.0, 0.0]), *[(i, [float(a), float(b)]) for i, (a, b) in enumerate([(19, 6.244997998398398), (19, 6.2449979983983975), (19, 6.244997998398399), (0.95, 0.3122498999199199), (3, 1)], 1)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def linked(v, w):
        f = lambda a, b: sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
        return f(v, w) > 0 and f(v, w) ** 2 >= Fraction("0.95") ** 2 * f(v, v) * f(w, w) * (1 - Fraction(1, 10**15))

    crowd = [(100 + i, [float(-100 - i), 1.0]) for i in range(60)]
    for extra in ([], crowd):
        got = {r.vec_id: r.n_links for r in vector_dedup.links(df.union(spark.createDataFrame(extra, df.schema)), miss=1e-9).collect()}
        if not extra:
            alone = got
    assert {i: got[i] for i, _ in rows} == alone
    clear = [i for i, v in rows if all(abs(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) - 0.95) > 1e-12 for j, w in rows if i != j)]
    assert all(alone[i] == sum(linked(v, w) for j, w in rows if j != i) for i, v in rows if i in clear)


def test_large_components(spark):
    path = spark.range(1, 60).selectExpr("id as a", "id + 1 as b")
    star = spark.range(1000, 1400).selectExpr("id as a", "999L as b")
    got = {r.id: r.component for r in connected_components(path.union(star).union(spark.sql("select 5L, cast(null as long)"))).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 999 for i in range(999, 1400))


def top(rows, k, scale=1024):
    ids = [i for i, _ in rows]
    x = np.floor(np.array([v for _, v in rows]) * scale).astype(np.int64)
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in zip(ids, x, strict=True) if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("slot,block,first", [(16384, 512, 4096), (50, 2, 100), (300, 3, 20)])
def test_top_k_equals_brute_force(spark, slot, block, first):
    rows = [(i // 7 * 4, v) for i, v in groups(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_search.top_k(df, df.where("vec_id % 100 = 0"), slot_rows=slot, query_rows=block, first_rows=first).collect()
    assert sorted(map(tuple, got)) == top(rows, 10)


def test_top_k_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = vector_search.top_k(df, df.where("vec_id % 100 = 0"), k=3).collect()
    fit = [(i, v) for i, v in ODD if i in (1, 2, 4, 9, 100, 200)]
    assert sorted(map(tuple, got)) == top(fit, 3)
    none = spark.createDataFrame([], SCHEMA)
    assert vector_search.top_k(none, none).count() == 0
    big = spark.createDataFrame([(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (100, [1.0e6, 5.0])], SCHEMA)
    assert sorted(map(tuple, vector_search.top_k(big, big.where("vec_id % 100 = 0")).collect())) == top([(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (100, [1.0e6, 5.0])], 10)


def test_bounds_hold():
    r = np.random.default_rng(5)
    x, y = r.standard_normal((200, 50)), r.standard_normal((30, 50))
    for s in (1, 4, 16, 50):
        assert (vector_search.segment_stats(y, s) @ vector_search.segment_stats(x, s).T >= y @ x.T - 1e-9).all()


def test_envelopes_and_bounds_spare_whole_meetings():
    """Queries that can't reach a slot never meet it, few pairs of a near one are multiplied out, and the result is whole."""
    r = np.random.default_rng(6)
    axis = np.repeat(np.eye(8), 8, axis=1)  # a direction that segment means show
    x = np.rint((axis[r.integers(0, 8, 4000)] + r.standard_normal((4000, 64)) * 0.05) * 1024).astype(np.int64)
    x = x[np.argsort(x[:, :8].sum(axis=1), kind="stable")]
    ids, queries = np.arange(4000), np.arange(4000, 4020)
    y = np.rint((axis[0] + r.standard_normal((20, 64)) * 0.05) * 1024).astype(np.int64)
    whole = y @ x.T
    reach = np.sort(whole, axis=1)[:, -10]
    slots = [vector_search.Slot(ids[s : s + 500], x[s : s + 500]) for s in range(0, 4000, 500)]
    found = [s.search(queries, y, 10, reach) for s in slots]
    got = sorted((int(q), int(-v), int(i)) for a in found for q, i, v in zip(*a, strict=True))
    want = sorted((q, int(-whole[q, i]), i) for q in range(20) for i in range(4000) if whole[q, i] >= reach[q])
    assert got == want
    assert sum(s.met == 0 for s in slots) >= 6 and sum(s.met for s in slots) < 0.2 * whole.size
    assert sum(s.met + s.pruned for s in slots) == whole.size


def test_repeated_rows_and_hot_ids(spark):
    df = spark.createDataFrame([(100, [1.0, 0.5])] * 3 + [(7, [1.0, 0.25])] * 400 + [(200, [0.5, 0.5])], SCHEMA)
    got = vector_search.top_k(df, df.where("vec_id % 100 = 0"), k=3, slot_rows=64, first_rows=50).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(100, 1, 7), (100, 2, 7), (100, 3, 7), (200, 1, 100), (200, 2, 100), (200, 3, 100)]


def test_registered_queries(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op5_exact_top_k(spark, sf).collect())) == top(rows, 10)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    got = {r.vec_id: r for r in queries.op7_vector_dedup(spark, sf).collect()}
    want = components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert {i: r.n_links for i, r in got.items()} == {i: int(n) - 1 for (i, _), n in zip(rows, near.sum(axis=1), strict=True)}
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (want[i] == i) for i, r in got.items())
